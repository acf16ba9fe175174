"""DuckDB statements that recompute each registered query independently of Spark.

They run on the same parquet tables (registered as views by the checker) and state every rule, list and
fixture on their own: from the queries they take only the parameters (keywords, limits, depths).  Folding
uses DuckDB's own ``strip_accents`` and folds the keywords in SQL too, counts use ``regexp_extract_all`` and
``replace``, lines come from ``string_split`` + ``generate_subscripts``, dedup uses window functions and
``list_has_all``, traversal uses recursive CTEs.  Regexes are RE2 here and java.util.regex in Spark.
"""

from __future__ import annotations

import re
from html.entities import html5

from trawl.plans import queries as Q

# Fixed values that must equal the search tool's or an HTML5 parser's.
DOC_SUFFIXES = "pdf doc docx txt xlsx odt pptx csv".split()
ASSET_SUFFIXES = "css js png jpg jpeg gif svg ico woff woff2 ttf otf mp3 mp4 wav avi mov wmv zip rar 7z tar.gz".split()
IGNORED_PARTS = ("googleads", "doubleclick", "facebook.com/sharer", "twitter.com/intent/tweet", "linkedin.com/share",
                 "pinterest.com/pin", "/tag/", "/tags/", "/author/")
JSON_SUFFIXES = "pdf docx xlsx odt doc pptx csv".split()
SEPARATING_TAGS = (
    "html head body frameset script noscript style meta link title frame noframes section nav aside hgroup header footer "
    "p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure figcaption form fieldset ins del dl dt dd li table "
    "caption thead tfoot tbody colgroup col tr th td video audio canvas details menu plaintext template article main svg "
    "math center dir applet marquee listing br"
).split()
FAILURES = {
    "SocketTimeoutException": "Timeout", "UnknownHostException": "DNS failure", "ConnectException": "Connection refused",
    "SSLException": "SSL error", "SSLHandshakeException": "SSL error", "SSLPeerUnverifiedException": "SSL error",
    "UnsupportedMimeTypeException": "Unsupported content type",
}
CATEGORIES = ("network_error", "blocked", "parse_error", "skipped_size", "skipped_type")
CATEGORY_LABELS = ("Network errors", "Blocked", "Parse errors", "Skipped (size limit)", "Skipped (type filter)")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2_escape(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


# ---------------------------------------------------------------------------------------------
# scalar builders
# ---------------------------------------------------------------------------------------------

def fold_spaces(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g')"


def fold_strict(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]', '', 'g')"


def count_lit(x: str, needle: str) -> str:
    """Non-overlapping occurrences; ``needle`` is an SQL expression."""
    return f"coalesce((length({x}) - length(replace({x}, {needle}, ''))) // length({needle}), 0)"


def count_ci(x: str, kw: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, {lit('(?i)' + re2_escape(kw))})), 0)"


def count_exact(x: str, kw: str) -> str:
    return count_lit(x, lit(kw))


def count_default(x: str, kw: str) -> str:
    folded = f"trim({fold_spaces(lit(kw))})"
    usable = f"NOT regexp_matches({lit(kw)}, '[\\x00-\\x1F!-/:-@\\[-`{{-\\x7F]') AND length({folded}) >= 2"
    return f"(CASE WHEN {usable} THEN greatest({count_ci(x, kw)}, {count_lit(fold_spaces(x), folded)}) ELSE {count_ci(x, kw)} END)"


def fuzzy_words(x: str, kw: str) -> str:
    k = fold_strict(lit(kw))
    near = f"CASE WHEN length({k}) <= 4 THEN 1 ELSE 2 END"
    return (
        f"(CASE WHEN length({k}) < 2 THEN 0 ELSE coalesce(len(list_filter(string_split({fold_spaces(x)}, ' '), lambda w: w <> '' AND "
        f"abs(length(w) - length({k})) <= {near} AND levenshtein(w, {k}) <= {near})), 0) END)"
    )


def count_fuzzy(x: str, kw: str) -> str:
    k = fold_strict(lit(kw))
    sub = count_lit(fold_strict(x), k)
    return f"(CASE WHEN length({k}) < 2 THEN 0 WHEN {sub} > 0 THEN {sub} ELSE {fuzzy_words(x, kw)} END)"


def count_matches(x: str, kw: str, mode: str) -> str:
    return {"exact": count_exact, "fuzzy": count_fuzzy, "default": count_default}[mode](x, kw)


def java_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def line_snippet(x: str) -> str:
    s = f"regexp_replace({java_trim(x)}, '[\\x00-\\x1f\\x7f]', '', 'g')"
    return f"(CASE WHEN length({s}) > 120 THEN substr({s}, 1, 117) || '...' ELSE {s} END)"


def lines_rel(src: str, ids: list[str], text: str = "text") -> str:
    """(ids..., page, line, line_text) for a relation ``src``."""
    idl = ", ".join(ids)
    return f"""(WITH _d AS (SELECT {idl}, regexp_replace({text}, '\\r\\n?', chr(10), 'g') AS _t FROM {src}),
  _p AS (SELECT {idl}, strpos(_t, chr(12)) > 0 AS _ff, unnest(string_split(_t, chr(12))) AS _pt,
                generate_subscripts(string_split(_t, chr(12)), 1) AS _pn FROM _d)
  SELECT {idl}, CAST(CASE WHEN _ff THEN _pn ELSE 0 END AS BIGINT) AS page,
         unnest(string_split(_pt, chr(10))) AS line_text,
         CAST(generate_subscripts(string_split(_pt, chr(10)), 1) AS BIGINT) AS line FROM _p)"""


def grep_lines(src: str, ids: list[str], kw: str, mode: str, text: str = "text") -> str:
    idl = ", ".join(ids)
    return f"""SELECT {idl}, page, line, CAST(count AS BIGINT) AS count, {line_snippet('line_text')} AS snippet
FROM (SELECT *, {count_matches('line_text', kw, mode)} AS count FROM {lines_rel(src, ids, text)}) WHERE count > 0"""


# --- HTML ----------------------------------------------------------------------------------------

#: The rest of a tag: quoted values may hold ``>``; a tag with an odd quote ends at the next ``>``.
REST = """(?:[^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>|[^>]*>)"""
#: From a tag's name to one of its attributes, over whole quoted values.
TO_ATTR = """(?:[\\s/](?:[^"'>]|"[^"]*"|'[^']*')*?)??[\\s/]"""
VALUE = """\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>"']+)"""


def strip_non_text(x: str) -> str:
    h = f"regexp_replace({x}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for tag in ("script", "style"):
        h = f"regexp_replace({h}, {lit('(?is)<' + tag + '(?:>|[' + chr(92) + 's/]' + REST + ').*?(?:</' + tag + chr(92) + 's*>|' + chr(92) + 'z)')}, ' ', 'g')"
    return h


def decode_entities(x: str) -> str:
    """Each reference once: numbers by ``chr``, names by the HTML5 table."""
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    pattern = lit("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|" + "|".join(legacy) + ")")
    named = "MAP {" + ", ".join(f"{lit('&' + k)}: {lit(v)}" for k, v in sorted(html5.items())) + "}"
    one = (
        "CASE WHEN r IS NULL THEN '' WHEN regexp_matches(r, '^&#[0-9]') THEN chr(regexp_extract(r, '[0-9]+')::INTEGER) "
        "WHEN starts_with(r, '&#') THEN chr(('0x' || regexp_extract(r, '[xX]([0-9a-fA-F]+)', 1))::INTEGER) "
        f"ELSE coalesce({named}[r], r) END"
    )
    refs = f"list_transform(list_append(regexp_extract_all({x}, {pattern}), NULL), lambda r: {one})"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {pattern}), {refs}), lambda p: p[1] || p[2]), '')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\f\\r\\x{{00A0}}]+', ' ', 'g'))"


def markup_to_text(x: str) -> str:
    block = "(?i)</?(?:" + "|".join(SEPARATING_TAGS) + ")(?:>|[\\s/]" + REST + ")"
    h = f"regexp_replace({x}, {lit(block)}, ' ', 'g')"
    h = f"regexp_replace({h}, {lit('(?s)<[/!?]?[a-zA-Z]' + REST)}, '', 'g')"
    return squash(decode_entities(h))


def body_html(x: str) -> str:
    after_body = f"regexp_extract({x}, {lit('(?is)<body(?:>|[' + chr(92) + 's/]' + REST + ')(.*)$')}, 1)"
    inner = f"regexp_replace({after_body}, '(?is)</body\\s*>.*$', '')"
    after_head = f"regexp_extract({x}, '(?is)</head\\s*>(.*)$', 1)"
    return (f"(CASE WHEN regexp_matches({x}, '(?i)<body[\\s/>]') THEN {inner} "
            f"WHEN regexp_matches({x}, '(?i)</head\\s*>') THEN {after_head} ELSE {x} END)")


def title_of(clean: str) -> str:
    title = "(?is)<title(?:>|[\\s/]" + REST + ")(.*?)</title\\s*>"
    return squash(decode_entities(f"regexp_extract({clean}, {lit(title)}, 1)"))


def unquote(v: str) -> str:
    return (f"(CASE WHEN length({v}) >= 2 AND ((starts_with({v}, '\"') AND ends_with({v}, '\"')) OR "
            f"(starts_with({v}, '''') AND ends_with({v}, ''''))) THEN substr({v}, 2, length({v}) - 2) ELSE {v} END)")


def meta_of(clean: str, name: str) -> str:
    quoted = f"""(?:"{name}"|'{name}'|{name}[\\s/]|{name}>)"""
    tag = f"regexp_extract({clean} || '>', {lit('(?is)(<meta' + TO_ATTR + 'name' + chr(92) + 's*=' + chr(92) + 's*' + quoted + '[^>]*)')}, 1)"
    return decode_entities(unquote(f"regexp_extract({tag}, {lit('(?is)^<meta' + TO_ATTR + 'content' + VALUE)}, 1)"))


def text_of(clean: str) -> str:
    return f"concat_ws(' ', {title_of(clean)}, {markup_to_text(body_html(clean))}, {meta_of(clean, 'description')}, {meta_of(clean, 'keywords')})"


def with_clean(rel: str, html: str = "html") -> str:
    """Relation ``rel`` plus ``_clean``, the page without comments, scripts and styles, computed once."""
    return f"(SELECT *, {strip_non_text(html)} AS _clean FROM {rel})"


ANCHOR = "(?is)<a" + TO_ATTR + "href" + VALUE
BASE_TAG = "(?is)<base" + TO_ATTR + "href" + VALUE
CHALLENGED = f"(contains({title_of('_clean')}, 'Just a moment...') OR contains({text_of('_clean')}, 'Enable JavaScript and cookies to continue'))"


# --- URLs ----------------------------------------------------------------------------------------

ABS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
SEG = r"(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)"


def dots(p: str) -> str:
    p = f"regexp_replace(regexp_replace({p}, '/\\./', '/', 'g'), '/\\./', '/', 'g')"
    p = f"regexp_replace({p}, '/\\.$', '/')"
    for _ in range(4):
        p = f"regexp_replace({p}, '/{SEG}/\\.\\./', '/')"
    return f"regexp_replace({p}, '/{SEG}/\\.\\.$', '/')"


def canonical_stage(rel: str, src: str, out: str) -> str:
    a = lit(ABS)
    inner = f"""SELECT *, regexp_matches({src}, {a}) AS _c_ok, lower(regexp_extract({src}, {a}, 1)) AS _c_proto,
  regexp_extract(regexp_extract({src}, {a}, 2), '(?s)^(?:[^@]*@)?(.*)$', 1) AS _c_hp,
  regexp_extract({src}, {a}, 3) AS _c_path, regexp_extract({src}, {a}, 4) AS _c_query FROM {rel}"""
    mid = f"""SELECT *, lower(regexp_extract(_c_hp, '(?s)^([^:]*)', 1)) AS _c_host,
  regexp_extract(_c_hp, '(?s)^[^:]*:(.*)$', 1) AS _c_port FROM ({inner})"""
    port_n = "(CASE WHEN _c_port = '' THEN -1 ELSE TRY_CAST(_c_port AS INTEGER) END)"
    deflt = "(CASE WHEN _c_proto = 'https' THEN 443 ELSE 80 END)"
    port_txt = f"(CASE WHEN {port_n} <> -1 AND {port_n} <> {deflt} THEN ':' || CAST({port_n} AS VARCHAR) ELSE '' END)"
    path = "regexp_replace(CASE WHEN _c_path = '' THEN '/' ELSE _c_path END, '/{2,}', '/', 'g')"
    good = "(_c_ok AND _c_proto IN ('http', 'https') AND _c_host <> '' AND (_c_port = '' OR regexp_matches(_c_port, '^[0-9]{1,9}$')))"
    return f"""SELECT * EXCLUDE (_c_ok, _c_proto, _c_hp, _c_path, _c_query, _c_host, _c_port),
  CASE WHEN {good} THEN _c_proto || '://' || _c_host || {port_txt} || {path} || _c_query ELSE '' END AS {out}
FROM ({mid})"""


def normalize_stage(rel: str, u: str, b: str | None, out: str, query_fix: bool = False) -> str:
    """Relation ``rel`` plus column ``out`` = normalize_url(u, b)."""
    bb = f"coalesce({b}, '')" if b else "''"
    a = lit(ABS)
    s1 = f"""SELECT *, coalesce({java_trim(u)}, '') AS _n_u0, {bb} AS _n_b FROM {rel}"""
    s2 = f"""SELECT *, CASE WHEN starts_with(_n_u0, '//') THEN (CASE WHEN starts_with(_n_b, 'https') THEN 'https:' ELSE 'http:' END) || _n_u0
  ELSE _n_u0 END AS _n_u1 FROM ({s1})"""
    spec = "(CASE WHEN starts_with(_n_u1, '?') THEN regexp_extract(_n_b, " + a + ", 3) || _n_u1 ELSE _n_u1 END)" if query_fix else "_n_u1"
    s3 = f"""SELECT *, regexp_matches(_n_u1, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND lower(regexp_extract(_n_u1, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) NOT IN ('http', 'https') AS _n_bad,
  regexp_matches(_n_u1, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS _n_auth, regexp_matches(_n_b, '(?i)^https?://') AS _n_bok,
  regexp_extract(_n_b, {a}, 1) AS _n_bs, regexp_extract(_n_b, {a}, 2) AS _n_ba, regexp_extract(_n_b, {a}, 3) AS _n_bp,
  regexp_extract(_n_b, {a}, 4) AS _n_bq, regexp_extract({spec}, '(?s)^([^#]*)', 1) AS _n_nf FROM ({s2})"""
    s4 = f"""SELECT *, contains(_n_nf, '?') AS _n_hq, regexp_extract(_n_nf, '(?s)^([^?]*)', 1) AS _n_sp,
  regexp_extract(_n_nf, '(?s)(\\?.*)$', 1) AS _n_sq, starts_with(_n_nf, '?') AS _n_qo FROM ({s3})"""
    merged = "(CASE WHEN _n_bp = '' THEN '/' || _n_sp ELSE regexp_extract(_n_bp, '(?s)^(.*/)', 1) || _n_sp END)"
    path = (f"(CASE WHEN starts_with(_n_sp, '/') THEN _n_sp WHEN _n_sp <> '' THEN {dots(merged)} "
            f"WHEN _n_qo THEN regexp_extract(_n_bp, '(?s)^(.*)/', 1) || '/' ELSE _n_bp END)")
    query = "(CASE WHEN _n_hq THEN _n_sq WHEN _n_sp = '' THEN _n_bq ELSE '' END)"
    resolved = f"_n_bs || '://' || _n_ba || {path} || {query}"
    prefixed = "(CASE WHEN starts_with(_n_u1, 'http') THEN _n_u1 ELSE 'http://' || _n_u1 END)"
    s5 = f"""SELECT *, CASE WHEN _n_auth THEN _n_u1 WHEN _n_bok THEN {resolved} ELSE {prefixed} END AS _n_abs FROM ({s4})"""
    s6 = canonical_stage(f"({s5})", "_n_abs", "_n_canon")
    return f"""SELECT * EXCLUDE (_n_u0, _n_b, _n_u1, _n_bad, _n_auth, _n_bok, _n_bs, _n_ba, _n_bp, _n_bq, _n_nf, _n_hq, _n_sp, _n_sq, _n_qo, _n_abs, _n_canon),
  CASE WHEN _n_u0 = '' OR _n_bad THEN '' ELSE _n_canon END AS {out} FROM ({s6})"""


def url_host(x: str) -> str:
    hp = f"regexp_extract(regexp_extract(coalesce({x}, ''), {lit(ABS)}, 2), '(?s)^(?:[^@]*@)?(.*)$', 1)"
    return f"lower(regexp_extract({hp}, '(?s)^([^:]*)', 1))"


def path_lower(x: str) -> str:
    return f"regexp_extract(lower(coalesce({x}, '')), '(?s)^([^#?]*)', 1)"


def suffix_re(sfx) -> str:
    return "\\.(" + "|".join(s.replace(".", "\\.") for s in sfx) + ")$"


def is_doc(x: str) -> str:
    return f"regexp_matches({path_lower(x)}, {lit(suffix_re(DOC_SUFFIXES))})"


def is_ignored(x: str) -> str:
    parts = "(" + "|".join(p.replace(".", "\\.") for p in IGNORED_PARTS) + ")"
    return (f"(NOT {is_doc(x)} AND (regexp_matches({path_lower(x)}, {lit(suffix_re(ASSET_SUFFIXES))}) "
            f"OR regexp_matches({path_lower(x)}, {lit(parts)})))")


def in_scope(h: str, seed_host: str) -> str:
    root = seed_host[4:] if seed_host.startswith("www.") else seed_host
    if seed_host.startswith("www."):
        return f"({h} = {lit(root)} OR ends_with({h}, {lit('.' + root)}))"
    return f"({h} = {lit(root)} OR {h} = {lit('www.' + root)})"


def ordered_distinct(rel: str, key: str, val: str, pos: str) -> str:
    """First occurrence of each ``val`` per ``key`` with 0-based positions renumbered."""
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY _mp) - 1 AS BIGINT) AS pos, {val}
FROM (SELECT {key}, {val}, min({pos}) AS _mp FROM {rel} GROUP BY {key}, {val})"""


# ---------------------------------------------------------------------------------------------
# derived views
# ---------------------------------------------------------------------------------------------

FX_URLS = """fx_urls AS (
  SELECT page_id * 8 + (v * 5 + page_id) % 8 AS seq,
    CASE v WHEN 0 THEN b || '?id=1' WHEN 1 THEN b || '?id=1&sort=asc' WHEN 2 THEN b || '?sort=asc&id=1' WHEN 3 THEN b || '?id=2'
      WHEN 4 THEN b WHEN 5 THEN sw || '?id=1' WHEN 6 THEN b || '?' ELSE b || '?&' END AS url
  FROM (SELECT page_id, b, CASE WHEN starts_with(b, 'https://') THEN 'http://' || substr(b, 9)
                             WHEN starts_with(b, 'http://') THEN 'https://' || substr(b, 8) ELSE b END AS sw
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b FROM pages)) p, range(8) t(v))"""


def raw_hrefs_sql(src: str = "pages") -> str:
    vals = f"regexp_extract_all(_clean, {lit(ANCHOR)}, 1)"
    return f"""SELECT page_id, url, CAST(generate_subscripts(_h, 1) - 1 AS BIGINT) AS pos, {decode_entities(unquote('unnest(_h)'))} AS href
FROM (SELECT page_id, url, {vals} AS _h FROM {with_clean(src)})"""


FX_LINKS = f"""fx_links AS (
  SELECT page_id, pos, href || (['', '.pdf', '.css', '.docx?v=2', '.PNG', '/tag/x', '#top', '?q=/tag/'])[CAST((page_id + pos) % 8 + 1 AS INTEGER)] AS href
  FROM ({raw_hrefs_sql()}))"""

FX_HREFS = """fx_hrefs AS (
  SELECT page_id, url, (['/a/../b', '//cdn.example.org/x', 'b', '?x=1', 'HTTP://EX.example.com:80//a//b', 'https://e.example.com:443',
    'javascript:void(0)', 'mailto:a@b.c', 'host.example.com:8080/x', './c#f'])[CAST(page_id % 10 + 1 AS INTEGER)] AS href FROM pages)"""

FX_FETCH_LOG = """fx_fetch_log AS (
  SELECT page_id, url,
    CASE WHEN page_id % 20 = 0 THEN 'https://blocked.example.org/' || page_id
         WHEN page_id % 10 = 4 THEN regexp_extract(b, '^([a-zA-Z]+://[^/]*)', 1) || '/landing'
         WHEN page_id % 10 = 6 AND starts_with(b, 'https://') THEN 'http://' || substr(b, 9)
         WHEN page_id % 10 = 6 AND starts_with(b, 'http://') THEN 'https://' || substr(b, 8)
         WHEN page_id % 10 = 8 THEN url || '#top' ELSE url END AS final_url,
    CAST(CASE page_id % 20 WHEN 0 THEN 403 WHEN 3 THEN 403 WHEN 7 THEN 429 WHEN 11 THEN 404 WHEN 13 THEN 500 WHEN 15 THEN NULL
         WHEN 17 THEN NULL WHEN 19 THEN NULL ELSE 200 END AS INTEGER) AS status,
    CASE page_id % 20 WHEN 15 THEN 'EOFException' WHEN 17 THEN 'SocketTimeoutException' WHEN 19 THEN 'IOException' END AS error_class,
    CASE WHEN page_id % 20 = 19 THEN 'stream closed' || chr(10) || 'at byte 7' END AS error_message,
    CASE WHEN page_id % 6 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN page_id % 9 <> 0 THEN CAST(strlen(body) AS VARCHAR) END AS content_length, body
  FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS b, CASE WHEN page_id % 20 = 9 THEN NULL WHEN page_id % 25 = 2
          THEN regexp_replace(html, '(?s)<title>.*?</title>', '<title>Just a moment...</title>', 'g') ELSE html END AS body FROM pages))"""

FX_PAGED = """fx_paged AS (
  SELECT doc_id // 3 AS doc_group, string_agg(text, chr(12) ORDER BY doc_id) AS text FROM documents GROUP BY doc_id // 3)"""

FX_CRLF = """fx_crlf AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13))
                 ELSE text END AS text FROM documents)"""

_INJECTED = (
    ("<html", '<html ng-version="17.3.0"'),
    ("<body>", '<body><div id="root"></div>'),
    ("<body>", '<body><div data-reactroot="">Loading...</div>'),
    ("<body>", '<body><script id="__NEXT_DATA__" type="application/json">{}</script>'),
    ("</head>", '<script src="/static/app.js"></script></head>'),
    ("</head>", '<meta name="description" content="Notes &amp; reviews"><meta name="keywords" content="alpha, beta"></head>'),
    ("<body>", '<base href="/app/"><body><a download href="files/report.pdf">Report</a>'),
    None,
    ("<body>", '<body><p title="a > b">caf&eacute; it&#8217;s &#x41;&amp;lt; &notin; &copy 2024 &unknown; 1 < 2</p>'),
    ("</article>", '</article><script type="a>b">var leaked = 1;'),
    ("<body>", '<body><a data-href="/wrong" href="/right">x</a><a title="q href=/no" href=\'/yes?a=1&amp;b\'>y</a>'),
    ("</head>", '<meta data-name="x" content="Second &mdash; order" name=description></head>'),
    ("<body>", '<body><p>open <!-- never closed <a href="/hidden">z</a>'),
    None,
    ("<body>", '<body><div id="app"><div>one</div>two<div><div>three</div></div></div>'),
    ("<body>", '<body><DIV class="a" id=root><div><p>' + "nested words " * 12 + "</p></div><div>and more of them</div></DIV>"),
    ("<body>", '<body><main><main>inner</main>outer<mainly>x</mainly>'),
)
FX_HTML = "fx_html AS (SELECT page_id, url, CASE page_id % 17 " + " ".join(
    f"WHEN {i} THEN replace(html, {lit(x[0])}, {lit(x[1])})" for i, x in enumerate(_INJECTED) if x
) + " ELSE html END AS html FROM pages)"

FX_JSON = """fx_json AS (
  SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS url_base,
    '{"files":["/a/' || CAST(page_id AS VARCHAR) || '.pdf","https://x.example.com/d/' || CAST(page_id AS VARCHAR) ||
    '/download","/p","//c.example.org/' || CAST(page_id AS VARCHAR) || '.csv?v=1"]}' AS body FROM pages)"""

FX_EDGES = """fx_edges AS (
  SELECT src, dst, pos, CASE WHEN dst % 5 = 0 THEN 'doc' ELSE 'nav' END AS kind
  FROM (SELECT page_id AS src, (page_id * 7 + k * 13 + 1) % (SELECT count(*) FROM pages) AS dst, k AS pos
        FROM pages, range(4) t(k)))"""

FX_SITE = FX_EDGES + """,
fx_site AS (
  SELECT page_id, 'http://site.example.com/' || page_id AS url, replace(html, '<body>', '<body>' || links) AS html
  FROM pages JOIN (SELECT src AS page_id, string_agg('<a href="/' || dst || CASE WHEN kind = 'doc' THEN '.pdf' ELSE '' END || '">l</a>', '' ORDER BY pos) AS links
                   FROM fx_edges GROUP BY src) USING (page_id))"""

def _site_url(t: str, scheme: str = "'http'") -> str:
    return f"""{scheme} || '://' || CASE WHEN site % 3 = 1 AND {t} > 0 THEN CASE WHEN {t} % 2 = 1 THEN 'en.m' ELSE 'www.m' END || site || '.example.org'
    ELSE 's' || site || '.example.com' END || '/' || {t} || CASE WHEN {t} > 0 AND {t} % 5 = 0 THEN '.pdf' ELSE '' END"""


FX_CRAWL_LOG = f"""_cl AS (SELECT page_id, page_id // 32 AS site, page_id % 32 AS j, html FROM pages),
_cl_links AS (
  SELECT page_id, string_agg('<a href="' || {_site_url('t', "CASE WHEN (j + k) % 4 = 2 THEN 'https' ELSE 'http' END")} ||
    CASE WHEN (t % 5 <> 0 OR t = 0) AND (j + k) % 4 = 1 THEN '?id=1' WHEN (t % 5 <> 0 OR t = 0) AND (j + k) % 4 = 3 THEN '?id=1&x=' || k ELSE '' END || '">l</a>', '' ORDER BY k)
    || '<a href="http://other.example.net/x">o</a>' AS links
  FROM (SELECT *, (j * 7 + k * 13 + 1) % 32 AS t FROM _cl, range(6) r(k)) GROUP BY page_id),
_cl_body AS (SELECT *, replace(html, '<body>', '<body>' || links) AS h, (j + 9) % 32 AS e FROM _cl JOIN _cl_links USING (page_id)),
_cl_rows AS (SELECT *, CASE WHEN page_id % 29 = 9 THEN NULL WHEN page_id % 23 = 6 THEN regexp_replace(h, '(?s)<title>.*?</title>', '<title>Just a moment...</title>', 'g') ELSE h END AS body FROM _cl_body),
fx_crawl_log AS (
  SELECT page_id, site, {_site_url('j')} AS url,
    CASE WHEN j = 0 AND site % 3 = 1 THEN 'http://www.m' || site || '.example.org/home' WHEN j % 7 = 2 THEN {_site_url('e')}
      WHEN j % 19 = 4 THEN {_site_url('j', "'https'")} ELSE {_site_url('j')} END AS final_url,
    CAST(CASE WHEN page_id % 11 = 3 THEN 404 WHEN page_id % 13 = 5 THEN 403 WHEN page_id % 17 <> 7 THEN 200 END AS INTEGER) AS status,
    CASE WHEN page_id % 17 = 7 THEN 'SocketTimeoutException' END AS error_class, CAST(NULL AS VARCHAR) AS error_message,
    CASE WHEN j > 0 AND j % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CAST(strlen(body) AS VARCHAR) AS content_length, body
  FROM _cl_rows)"""

FX_KEYWORDS = """fx_keywords AS (
  SELECT DISTINCT keyword, CASE length(keyword) % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'exact' ELSE 'fuzzy' END AS mode
  FROM (SELECT unnest(regexp_split_to_array(text, '[\\s.,]+')) AS keyword FROM benchmark UNION ALL SELECT unnest([chr(304) || '++', 'i++'])) WHERE keyword <> ''),
fx_noted AS (SELECT doc_id, text || CASE doc_id % 50 WHEN 7 THEN chr(10) || 'an i++ loop' WHEN 8 THEN chr(10) || 'an ' || chr(304) || '++ loop' ELSE '' END AS text FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------------------------
# statements
# ---------------------------------------------------------------------------------------------

def _doc_count(expr: str) -> str:
    return f"SELECT doc_id, CAST(c AS BIGINT) AS count FROM (SELECT doc_id, {expr} AS c FROM documents) WHERE c > 0"


def _lines_stmt(src_cte: str | None, src: str, ids, kw, mode) -> str:
    body = grep_lines(src, list(ids), kw, mode)
    return (with_(src_cte) + body) if src_cte else body


def _per_doc_lines(kw: str, mode: str) -> str:
    return f"SELECT doc_id, CAST(sum(count) AS BIGINT) AS total_matches, CAST(count(*) AS BIGINT) AS matching_lines, bool_or(page > 0) AS has_pages FROM ({grep_lines('documents', ['doc_id'], kw, mode)}) GROUP BY doc_id"


def _dedup(src_cte: str, all_urls: bool) -> str:
    if not all_urls:
        return f"{src_cte},\n{_smart_ctes('fx_urls', '_')}\n"
    key = "CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END"
    return f"{src_cte},\n_acc AS (SELECT min(seq) AS seq, arg_min(url, seq) AS url FROM fx_urls GROUP BY {key})\n"


def _smart_ctes(rel: str, pre: str) -> str:
    """CTEs that dedup ``rel`` (seq, url) by the smart rules; ``{pre}acc`` has the accepted rows."""
    tokens = ("(CASE WHEN _q = '' THEN [''] WHEN regexp_replace(_q, '&+$', '') = '' THEN []::VARCHAR[] "
              "ELSE list_distinct(string_split(regexp_replace(_q, '&+$', ''), '&')) END)")
    return f"""{pre}u AS (SELECT seq, url, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS key FROM {rel}),
{pre}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS _rk FROM {pre}u) WHERE _rk = 1),
{pre}p AS (SELECT *, strpos(key, '?') > 0 AS has_q,
         CASE WHEN strpos(key, '?') > 0 THEN substr(key, 1, strpos(key, '?') - 1) ELSE key END AS base,
         CASE WHEN strpos(key, '?') > 0 THEN substr(key, strpos(key, '?') + 1) ELSE NULL END AS _q FROM {pre}f),
{pre}t AS (SELECT *, CASE WHEN has_q THEN {tokens} ELSE []::VARCHAR[] END AS params FROM {pre}p),
{pre}g AS (SELECT *, first_value(params) OVER (PARTITION BY base ORDER BY seq) AS canon,
         row_number() OVER (PARTITION BY base ORDER BY seq) AS _rb FROM {pre}t),
{pre}acc AS (SELECT seq, url FROM {pre}g WHERE _rb = 1 OR NOT ((has_q AND len(canon) > 0 AND list_has_all(params, canon)) OR (NOT has_q AND len(canon) = 0)))"""


def _redirect_dups_ctes() -> str:
    """A fetch that returned and ended on another page (beyond scheme and fragment) than it asked for arrives there at
    odd order numbers; it is a duplicate if that page is not accepted then."""
    asked = normalize_stage("fx_fetch_log", "url", None, "_asked")
    both = normalize_stage(f"({asked})", "final_url", None, "_got")
    key = "regexp_replace({0}, '^http://', 'https://')"
    return f"""_both AS (SELECT page_id, _asked, CASE WHEN status < 400 AND error_class IS NULL AND {key.format('_got')} <> {key.format('_asked')} THEN _got END AS _got FROM ({both})),
_ev AS (SELECT page_id * 2 AS seq, _asked AS url FROM _both WHERE _asked <> '' UNION ALL SELECT page_id * 2 + 1, _got FROM _both WHERE _got <> ''),
{_smart_ctes('_ev', '_r')},
_rdup AS (SELECT CAST(seq // 2 AS BIGINT) AS page_id FROM _ev WHERE seq % 2 = 1 AND seq NOT IN (SELECT seq FROM _racc))"""


KIND = "(CASE WHEN regexp_matches(coalesce(content_type, ''), 'text/html|application/xhtml[+]xml') THEN 'html' ELSE 'document' END)"


def _outcomes_ctes() -> str:
    lim = Q.FETCH_LIMIT
    over = f"(coalesce(TRY_CAST(content_length AS BIGINT) > {lim}, false) OR coalesce(strlen(body) > {lim}, false))"
    reasons = " ".join(f"WHEN {lit(c)} THEN {lit(l)}" for c, l in FAILURES.items())
    return f"""{FX_FETCH_LOG},
{_redirect_dups_ctes()},
_o1 AS (SELECT page_id, url, final_url, status, error_class, error_message, {KIND} AS kind, {over} AS _over, body IS NULL AS _none,
          {KIND} = 'html' AND coalesce({CHALLENGED}, false) AS _chall, page_id IN (SELECT page_id FROM _rdup) AS _rd FROM {with_clean('fx_fetch_log', 'body')}),
_oc AS (SELECT page_id, url, final_url, kind, status, error_class, error_message,
   CASE WHEN status IN (403, 429) THEN 'blocked' WHEN status >= 400 THEN 'network_error'
        WHEN error_class IS NOT NULL THEN 'network_error' WHEN _rd THEN 'redirect_duplicate'
        WHEN _over THEN 'skipped_size' WHEN kind = 'html' AND _none THEN 'parse_error' WHEN _chall THEN 'challenge' ELSE 'ok' END AS outcome FROM _o1),
outcomes AS (SELECT *, CASE outcome WHEN 'blocked' THEN 'blocked' WHEN 'challenge' THEN 'blocked' WHEN 'network_error' THEN 'network_error'
        WHEN 'skipped_size' THEN 'skipped_size' WHEN 'parse_error' THEN 'parse_error' END AS category,
   CASE WHEN outcome = 'blocked' THEN 'HTTP ' || status || ' (Access Denied/Rate Limited)' WHEN outcome = 'network_error' AND status >= 400 THEN 'HTTP ' || status
        WHEN outcome = 'network_error' THEN CASE error_class {reasons} ELSE coalesce(string_split(error_message, chr(10))[1], error_class) END
        WHEN outcome = 'challenge' THEN 'Cloudflare/Bot protection challenge' END AS reason FROM _oc)
"""


VISITED = "outcome IN ('redirect_duplicate', 'skipped_size', 'parse_error', 'challenge', 'ok')"


def _crawl_ctes() -> str:
    """Outcomes and ``results`` (url, seq, count, snippets as a list): page text of HTML, the body of documents, summed per final URL."""
    lim = Q.FETCH_LIMIT
    text = f"(CASE WHEN {KIND} = 'html' THEN {text_of('_clean')} ELSE body END)"
    hits = f"""SELECT page_id, {count_default('_t', Q.KW_PAGES)} AS c, _t FROM (SELECT page_id, {text} AS _t FROM {with_clean('fx_fetch_log', 'body')}
  WHERE body IS NOT NULL AND page_id IN (SELECT page_id FROM outcomes WHERE outcome = 'ok'))"""
    final = normalize_stage("(SELECT page_id, final_url FROM outcomes)", "final_url", None, "_fn")
    return f"""{_outcomes_ctes()},
_hits AS MATERIALIZED (SELECT page_id, c, _t FROM ({hits}) WHERE c > 0),
_fin AS (SELECT page_id, CASE WHEN _fn <> '' THEN _fn ELSE final_url END AS url FROM ({final})),
_snip AS ({find_snippets('_hits', 'page_id', '_t', Q.KW_PAGES, 'default')}),
results AS (SELECT url, min(page_id) AS seq, CAST(sum(c) AS BIGINT) AS count, arg_min(coalesce(snippets, []), page_id) AS snippets
  FROM _hits JOIN _fin USING (page_id) LEFT JOIN _snip USING (page_id) GROUP BY url)"""


def _bfs(edges_cte: str, depth: int, scope: str | None, doc_leaves: bool, extra_ctes: str = "") -> str:
    kind = "e.kind" if doc_leaves else "'nav'"
    scope_cond = f" AND {scope}" if scope else ""
    return f"""WITH RECURSIVE {edges_cte}{extra_ctes},
r(node, depth, kind) AS (
  SELECT CAST(0 AS BIGINT), 0, 'nav'
  UNION
  SELECT e.dst, r.depth + 1, {kind} FROM r JOIN fx_edges e ON e.src = r.node
  WHERE r.kind = 'nav' AND (r.depth < {depth} {"OR e.kind = 'doc'" if doc_leaves else ''}) AND r.depth <= {depth}{scope_cond}
    {"AND NOT (r.depth >= " + str(depth) + " AND e.kind <> 'doc')" if doc_leaves else ''}
)
"""


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["count_exact"] = _doc_count(count_exact("text", Q.KW_EXACT))
    s["count_ci"] = _doc_count(count_ci("text", Q.KW_CI))
    s["count_default"] = _doc_count(count_default("text", Q.KW_DEFAULT))
    s["count_fuzzy"] = _doc_count(count_fuzzy("text", Q.KW_FUZZY))
    s["fuzzy_words"] = _doc_count(fuzzy_words("text", Q.KW_FUZZY_WORDS))
    s["fold_strict"] = f"SELECT doc_id, {fold_strict('text')} AS folded FROM documents"
    s["fold_spaces"] = f"SELECT doc_id, {fold_spaces('text')} AS folded FROM documents"
    total_c = "((n_chars + 5) // 10)"
    rem_c = "(((n_chars % 60000) + 5) // 10)"
    s["format_duration"] = (
        f"SELECT doc_id, CASE WHEN n_chars < 60000 THEN printf('%d.%02ds', {total_c} // 100, {total_c} % 100) "
        f"ELSE printf('%dm %d.%02ds', n_chars // 60000, {rem_c} // 100, {rem_c} % 100) END AS label FROM documents"
    )
    s["grep_lines"] = grep_lines("documents", ["doc_id"], Q.KW_CI, "default")
    s["grep_lines_exact"] = grep_lines("documents", ["doc_id"], Q.KW_EXACT, "exact")
    s["grep_lines_fuzzy"] = grep_lines("documents", ["doc_id"], Q.KW_LINES_FUZZY, "fuzzy")
    s["grep_paged"] = with_(FX_PAGED) + grep_lines("fx_paged", ["doc_group"], Q.KW_CI, "default")
    s["grep_crlf"] = with_(FX_CRLF) + grep_lines("fx_crlf", ["doc_id"], Q.KW_CI, "default")
    s["grep_conversations"] = grep_lines("conversations", ["conv_id", "turn"], Q.KW_CI, "default")
    s["grep_files"] = _per_doc_lines(Q.KW_DEFAULT, "default")
    s["file_totals"] = f"SELECT doc_id, CAST(c AS BIGINT) AS total_matches FROM (SELECT doc_id, {count_default('text', Q.KW_TOTALS)} AS c FROM documents) WHERE c > 0"
    s["stream_grep"] = s["grep_lines"]
    parts = []
    for kw, mode in (("elle", "default"), ("ete", "default"), ("that the", "exact"), ("hten", "fuzzy"), ("C++", "default")):
        parts.append(f"SELECT doc_id, {lit(kw)} AS keyword, {lit(mode)} AS mode, page, line, count, snippet FROM ({grep_lines('documents', ['doc_id'], kw, mode)})")
    s["multi_keyword_grep"] = "\nUNION ALL\n".join(parts)
    s["stream_totals"] = f"""SELECT doc_id * 60 // 3600 * 3600 AS window_start, keyword, mode, sum(count)::BIGINT AS total_matches, count(*) AS matching_lines
FROM ({s["multi_keyword_grep"]}) GROUP BY ALL"""
    per_doc = f"SELECT doc_id, CAST(sum(count) AS BIGINT) AS total_matches FROM ({grep_lines('documents', ['doc_id'], Q.KW_CI, 'default')}) GROUP BY doc_id"
    s["max_hits_cut"] = f"""SELECT doc_id, total_matches FROM (SELECT *, coalesce(sum(total_matches) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _b FROM ({per_doc})) WHERE _b < {Q.MAX_HITS}"""
    s["running_matches"] = f"SELECT doc_id, total_matches, CAST(sum(total_matches) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM ({per_doc})"
    fm = Q.FOLDER_MAX_BYTES
    s["folder_stats"] = f"""WITH f AS (SELECT doc_id, strlen(text) AS length, text FROM documents),
m AS (SELECT doc_id, CAST(sum(count) AS BIGINT) AS total_matches FROM ({grep_lines('(SELECT * FROM f WHERE length <= ' + str(fm) + ')', ['doc_id'], Q.KW_CI, 'default')}) GROUP BY doc_id)
SELECT CAST(count_if(length <= {fm}) AS BIGINT) AS files_scanned, CAST(count_if(length > {fm}) AS BIGINT) AS files_skipped,
  CAST(0 AS BIGINT) AS files_failed, CAST(count_if(coalesce(total_matches, 0) > 0) AS BIGINT) AS files_with_matches,
  CAST(coalesce(sum(total_matches), 0) AS BIGINT) AS total_matches FROM f LEFT JOIN m USING (doc_id)"""

    # keyword table: every line against every keyword
    k_lines = lines_rel("fx_noted", ["doc_id"])
    s["keyword_table_grep"] = with_(FX_KEYWORDS) + f"""SELECT doc_id, keyword, mode, page, line, CAST(count AS BIGINT) AS count, {line_snippet('line_text')} AS snippet FROM (
  SELECT *, CASE mode WHEN 'exact' THEN {count_lit('line_text', 'keyword')}
    WHEN 'default' THEN greatest({count_lit('lower(line_text)', 'lower(keyword)')}, CASE WHEN length(ks) >= 2 THEN {count_lit('fs', 'ks')} ELSE 0 END)
    ELSE CASE WHEN length(kt) < 2 THEN 0 WHEN {count_lit('ft', 'kt')} > 0 THEN {count_lit('ft', 'kt')}
      ELSE coalesce(len(list_filter(words, lambda w: w <> '' AND abs(length(w) - length(kt)) <= 2 AND levenshtein(w, kt) <= CASE WHEN length(kt) <= 4 THEN 1 ELSE 2 END)), 0) END END AS count
  FROM (SELECT *, {fold_spaces('line_text')} AS fs, {fold_strict('line_text')} AS ft, string_split({fold_spaces('line_text')}, ' ') AS words FROM {k_lines}),
    (SELECT *, trim({fold_spaces('keyword')}) AS ks, {fold_strict('keyword')} AS kt FROM fx_keywords)) WHERE count > 0"""

    # pages
    html_clean = with_clean("fx_html")
    s["page_text"] = with_(FX_HTML) + f"SELECT page_id, {text_of('_clean')} AS text FROM {html_clean}"
    s["page_title"] = with_(FX_HTML) + f"SELECT page_id, {title_of('_clean')} AS title FROM {html_clean}"
    s["main_content_text"] = with_(FX_HTML) + f"SELECT page_id, {main_content_text('html')} AS text FROM fx_html"
    texts = f"(SELECT page_id, url, {text_of('_clean')} AS _t FROM {with_clean('pages')})"
    counted = f"_c AS MATERIALIZED (SELECT * FROM (SELECT page_id, url, _t, {count_default('_t', Q.KW_PAGES)} AS c FROM {texts}) WHERE c > 0)"
    shown = f"""WITH {counted},
_sn AS ({find_snippets('_c', 'page_id', '_t', Q.KW_PAGES, 'default')}),
_r AS (SELECT page_id, url, CAST(c AS BIGINT) AS count, coalesce(array_to_string(snippets, chr(10)), '') AS snippets,
  CAST(greatest(c - coalesce(len(snippets), 0), 0) AS BIGINT) AS more FROM _c LEFT JOIN _sn USING (page_id))
"""
    s["grep_pages"] = f"WITH {counted} SELECT page_id, url, CAST(c AS BIGINT) AS count FROM _c"
    s["grep_pages_snippets"] = shown + "SELECT * FROM _r"
    s["grep_pages_ranked"] = shown + "SELECT CAST(row_number() OVER (ORDER BY count DESC, url, page_id) AS BIGINT) AS rank, * FROM _r"
    s["url_totals"] = f"WITH {counted} SELECT _nu AS url, CAST(sum(c) AS BIGINT) AS count FROM ({normalize_stage('_c', 'url', None, '_nu')}) GROUP BY _nu"
    s["page_meta"] = with_(FX_HTML) + f"SELECT page_id, {meta_of('_clean', 'description')} AS description, {meta_of('_clean', 'keywords')} AS keywords FROM {html_clean}"
    s["spa_pages"] = with_(FX_HTML) + f"SELECT page_id, {is_spa('html')} AS is_spa FROM fx_html"
    anchor_tag = "(?is)(<a" + TO_ATTR + "href" + VALUE + REST + ")"
    s["anchor_rules"] = with_(FX_HTML) + f"""SELECT page_id, pos, href, is_download FROM (
  SELECT page_id, pos, {decode_entities(unquote(f"regexp_extract(tag, {lit(ANCHOR)}, 1)"))} AS href,
         regexp_matches(tag, {lit('(?is)^<a' + TO_ATTR + 'download[' + chr(92) + 's=>/]')}) AS is_download
  FROM (SELECT page_id, CAST(generate_subscripts(_t, 1) - 1 AS BIGINT) AS pos, unnest(_t) AS tag
        FROM (SELECT page_id, regexp_extract_all(_clean, {lit(anchor_tag)}, 1) AS _t FROM {html_clean})))
WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') AND NOT starts_with(href, 'mailto:')"""
    no_anchors = "(SELECT page_id, url, regexp_replace(html, '(?i)<a([[:space:]])', '<area\\1', 'g') AS html FROM fx_html)"
    fb = f"""SELECT page_id, url, generate_subscripts(_h, 1) AS _i, {decode_entities('unnest(_h)')} AS raw FROM (SELECT page_id, url,
  regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) AS _h FROM {no_anchors})"""
    fb_base = normalize_stage(f"({fb})", "url", None, "_base")
    fb_norm = normalize_stage(f"({fb_base})", "raw", "_base", "link", query_fix=False)
    fb_keep = f"SELECT page_id, _i, link FROM ({fb_norm}) WHERE link <> '' AND NOT {is_ignored('link')}"
    s["extract_links_fallback"] = with_(FX_HTML) + ordered_distinct(f"({fb_keep})", "page_id", "link", "_i")
    s["extract_links"] = with_(FX_HTML) + _extract_links_sql("fx_html", with_base_tag=True)
    s["link_graph"] = f"""WITH l AS ({_extract_links_sql('pages', with_src=True)})
SELECT src, pos, link AS dst, CASE WHEN {is_doc('link')} THEN 'doc' ELSE 'nav' END AS kind FROM l"""
    s["host_rollup"] = f"""WITH l AS ({_extract_links_sql('pages', with_src=True)})
SELECT {url_host('link')} AS host, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT src) AS BIGINT) AS pages FROM l GROUP BY 1"""
    known = normalize_stage("pages", "url", None, "_k")
    s["dangling_links"] = f"""WITH l AS ({_extract_links_sql('pages', with_src=True)}), k AS (SELECT _k FROM ({known}))
SELECT src, pos, link AS dst FROM l WHERE link NOT IN (SELECT _k FROM k)"""
    s["normalize_url"] = f"SELECT page_id, normalized FROM ({normalize_stage('pages', 'url', None, 'normalized')})"
    s["resolve_links"] = with_(FX_HREFS) + f"SELECT page_id, href, resolved FROM ({normalize_stage('fx_hrefs', 'href', 'url', 'resolved')})"
    s["classify_links"] = with_(FX_LINKS) + f"SELECT page_id, pos, href, {is_doc('href')} AS is_doc, {is_ignored('href')} AS is_ignored FROM fx_links"
    hn = normalize_stage("pages", "url", None, "_nu")
    s["site_scope"] = f"""WITH h AS (SELECT page_id, {url_host('_nu')} AS host FROM ({hn})),
seeds AS (SELECT seed_id, CASE WHEN seed_id % 2 = 1 THEN 'www.' || regexp_replace(host, '^www[.]', '') ELSE host END AS seed_host
  FROM (SELECT host, min(page_id) AS seed_id FROM h GROUP BY host)),
r AS (SELECT *, regexp_replace(seed_host, '^www[.]', '') AS root, starts_with(seed_host, 'www.') AS wide FROM seeds)
SELECT page_id, host, seed_id, seed_host FROM h JOIN r ON host <> '' AND (CASE WHEN wide THEN host = root OR ends_with(host, '.' || root)
  ELSE host = root OR host = 'www.' || root END)"""

    # dedup
    s["dedup_smart"] = "WITH " + _dedup(FX_URLS, False) + "SELECT CAST(seq AS BIGINT) AS seq, url FROM _acc"
    s["dedup_all_urls"] = "WITH " + _dedup(FX_URLS, True) + "SELECT CAST(seq AS BIGINT) AS seq, url FROM _acc"
    s["dedup_exact"] = "WITH " + _dedup(FX_URLS, True) + "SELECT CAST(u.seq AS BIGINT) AS seq, u.url, a.seq IS NULL AS duplicate FROM fx_urls u LEFT JOIN _acc a ON a.seq = u.seq"
    s["stream_url_dedup"] = "WITH " + _dedup(FX_URLS, False) + "SELECT CAST(u.seq AS BIGINT) AS seq, u.url, a.seq IS NOT NULL AS accepted FROM fx_urls u LEFT JOIN _acc a ON a.seq = u.seq"
    s["dedup_size"] = ("WITH " + _dedup(FX_URLS, False) + ", _s AS (SELECT count(*) AS n FROM _acc)\n"
                       + "SELECT 'smart' AS mode, CAST(n AS BIGINT) AS accepted FROM _s UNION ALL "
                       + "SELECT 'all_urls', CAST(count(DISTINCT CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END) AS BIGINT) FROM fx_urls")

    # fetch log
    oc = "WITH " + _outcomes_ctes()
    s["fetch_outcomes"] = oc + "SELECT page_id, outcome, category, reason FROM outcomes"
    lim = Q.FETCH_LIMIT
    s["size_gate"] = with_(FX_FETCH_LOG) + f"SELECT page_id, (coalesce(TRY_CAST(content_length AS BIGINT) > {lim}, false) OR coalesce(strlen(body) > {lim}, false)) AS skipped FROM fx_fetch_log"
    s["route_content"] = with_(FX_FETCH_LOG) + f"SELECT page_id, {KIND} AS kind FROM fx_fetch_log"
    s["bot_challenge"] = with_(FX_FETCH_LOG) + f"SELECT page_id, url FROM {with_clean('fx_fetch_log', 'body')} WHERE {CHALLENGED}"
    dim = " UNION ALL ".join(f"SELECT {i} AS ord, {lit(t)} AS category" for i, t in enumerate(CATEGORIES))
    s["error_counts"] = oc + f", dim AS ({dim}) SELECT d.category, CAST(count(o.page_id) AS BIGINT) AS count FROM dim d LEFT JOIN outcomes o ON o.category = d.category GROUP BY d.category"
    s["error_reasons"] = oc + "SELECT reason, CAST(count(*) AS BIGINT) AS count FROM outcomes WHERE outcome = 'network_error' GROUP BY reason"
    s["blocked_by_reason"] = oc + """, b AS (SELECT reason, page_id, CASE WHEN outcome = 'challenge' THEN final_url ELSE url END AS url FROM outcomes WHERE outcome IN ('blocked', 'challenge'))
SELECT reason, CAST(count(*) AS BIGINT) AS count, CAST(greatest(count(*) - 10, 0) AS BIGINT) AS more,
  array_to_string(list(url ORDER BY page_id)[1:10], ' ') AS first_urls FROM b GROUP BY reason"""
    s["crawl_stats"] = oc + """SELECT CAST(count_if(outcome IN ('redirect_duplicate', 'skipped_size', 'parse_error', 'challenge', 'ok')) AS BIGINT) AS pages_visited,
  CAST(count_if(outcome = 'ok') AS BIGINT) AS pages_parsed, CAST(count_if(outcome = 'ok' AND kind = 'document') AS BIGINT) AS docs_parsed,
  CAST(greatest(count_if(outcome = 'ok') - count_if(outcome = 'ok' AND kind = 'document'), 0) AS BIGINT) AS html_pages,
  CAST(count_if(outcome IN ('blocked', 'challenge')) AS BIGINT) AS pages_blocked FROM outcomes"""
    s["dedup_redirects"] = "WITH " + FX_FETCH_LOG + ",\n" + _redirect_dups_ctes() + "\nSELECT page_id FROM _rdup"
    docs = "(?i)^(https?://.+|/[^\\s?]+)[.](" + "|".join(JSON_SUFFIXES) + ")([?].*)?$"
    s["json_doc_links"] = with_(FX_JSON) + f"""SELECT page_id, CAST(generate_subscripts(_f, 1) - 1 AS BIGINT) AS pos,
  CASE WHEN starts_with(unnest(_f), '//') THEN (CASE WHEN starts_with(url_base, 'https') THEN 'https:' ELSE 'http:' END) || unnest(_f)
       WHEN starts_with(unnest(_f), '/') THEN url_base || unnest(_f) ELSE unnest(_f) END AS link
FROM (SELECT page_id, url_base, list_concat(list_filter(_s, lambda v: regexp_matches(v, {lit(docs)})),
        list_filter(_s, lambda v: regexp_matches(v, '(?i)^(https?://|/)[^\\s]{{4,}}/download$'))) AS _f
      FROM (SELECT page_id, url_base, regexp_extract_all(body, '"([^"]*)"', 1) AS _s FROM fx_json))"""

    # traversal
    s["bfs_depth"] = _bfs(FX_EDGES, Q.BFS_DEPTH, None, False) + "SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"
    hosts = normalize_stage("pages", "url", None, "_nu")
    scoped_edges = FX_EDGES.replace("fx_edges AS (", "_fx_edges0 AS (")
    scope_ctes = f""", _hosts AS (SELECT page_id AS node, {url_host('_nu')} AS host FROM ({hosts})),
fx_edges AS (SELECT e.* FROM _fx_edges0 e JOIN _hosts h ON h.node = e.dst WHERE regexp_matches(h.host, {lit(Q.SCOPE_HOST_REGEX)}))"""
    s["bfs_scoped"] = _bfs(scoped_edges, Q.BFS_DEPTH, None, False, scope_ctes) + "SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"
    s["bfs_doc_leaves"] = _bfs(FX_EDGES, 2, None, True) + """SELECT node, CAST(depth AS BIGINT) AS depth, kind FROM (
  SELECT node, depth, kind, row_number() OVER (PARTITION BY node ORDER BY depth, kind) AS _r FROM r) WHERE _r = 1"""
    hit_rows = literal_hits("(SELECT doc_id, " + flat_sql("text") + " AS flat FROM documents)", "doc_id", "flat", lit(Q.KW_SNIPPET))
    s["build_snippet"] = f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS hit, snippet FROM ({snippet_stages('(' + hit_rows + ')')})"
    for name, kw, mode in (("snippets_exact", Q.KW_EXACT, "exact"), ("snippets_default", Q.KW_DEFAULT, "default"), ("snippets_fuzzy", Q.KW_SNIPPETS_FUZZY, "fuzzy")):
        s[name] = f"""WITH _c AS MATERIALIZED (SELECT * FROM (SELECT doc_id, text, {count_matches('text', kw, mode)} AS c FROM documents) WHERE c > 0),
_sn AS ({find_snippets('_c', 'doc_id', 'text', kw, mode)})
SELECT doc_id, CAST(c AS BIGINT) AS count, coalesce(array_to_string(snippets, chr(10)), '') AS snippets FROM _c LEFT JOIN _sn USING (doc_id)"""
    s |= _report_statements() | _crawl_statements()
    return s


def flat_sql(x: str) -> str:
    one = f"regexp_replace({x}, '[\\r\\n\\t\\x{{00A0}}]+', ' ', 'g')"
    return java_trim(f"regexp_replace({one}, ' {{2,}}', ' ', 'g')")


def snippet_stages(rel: str, out: str = "snippet") -> str:
    """Relation with (flat, n, s, e) -> plus ``out``: the context excerpt of match [s, e)."""
    s1 = f"SELECT *, greatest(s - 60, 0) AS _lo0, least(e + 60, n) AS _hi0 FROM {rel}"
    s2 = f"""SELECT *, strpos(reverse(substr(flat, 1, _lo0)), ' ') AS _r, strpos(substr(flat, _hi0 + 1), ' ') AS _h FROM ({s1})"""
    s3 = f"""SELECT *, CASE WHEN _lo0 = 0 OR _r = 0 THEN 0 ELSE _lo0 - _r + 1 END AS _lo,
  CASE WHEN _hi0 >= n OR _h = 0 THEN n ELSE _hi0 + _h - 1 END AS _hi FROM ({s2})"""
    body = java_trim("substr(flat, _lo + 1, _hi - _lo)")
    s4 = f"""SELECT *, regexp_replace((CASE WHEN _lo > 0 THEN '...' ELSE '' END) || {body} || (CASE WHEN _hi < n THEN '...' ELSE '' END),
  '[\\x00-\\x1f\\x7f]', '', 'g') AS _sn FROM ({s3})"""
    return f"""SELECT * EXCLUDE (_lo0, _hi0, _r, _h, _lo, _hi, _sn),
  CASE WHEN length(_sn) > 500 THEN substr(_sn, 1, 497) || '...' ELSE _sn END AS {out} FROM ({s4})"""


def match_rows(rel: str, key: str, flat: str, searched: str, pattern: str) -> str:
    """(key, flat, n, i, s, e): the matches of ``pattern`` in ``searched``, which is as long as ``flat``, 0-based."""
    return f"""SELECT {key}, flat, n, i, s, s + ml AS e FROM (
  SELECT *, CAST(sum(pl) OVER (PARTITION BY {key} ORDER BY i) + coalesce(sum(ml) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT {key}, flat, length(flat) AS n, generate_subscripts(ms, 1) AS i, length(unnest(ms)) AS ml, length(unnest(ps[1:len(ms)])) AS pl
        FROM (SELECT {key}, {flat} AS flat, regexp_extract_all({searched}, {pattern}) AS ms, regexp_split_to_array({searched}, {pattern}) AS ps FROM {rel}) WHERE len(ms) > 0))"""


def literal_hits(rel: str, key: str, flat: str, needle: str) -> str:
    return match_rows(rel, key, flat, flat, f"regexp_escape({needle})")


def find_snippets(rel: str, key: str, text: str, kw: str, mode: str, most: int = 3) -> str:
    """(key, snippets): the first distinct excerpts of literal matches, then of matches of the folded keyword."""
    assert kw.isascii() and kw.replace(" ", "").isalnum(), "the keywords of the catalogue need no folding of their own"
    flat = f"(SELECT {key}, {flat_sql(text)} AS flat FROM {rel})"
    literal = lit(("" if mode == "exact" else "(?i)") + re2_escape(kw))
    passes = [snippet_stages("(SELECT *, 1 AS pass FROM (" + match_rows(flat, key, "flat", "flat", literal) + "))")]
    if mode != "exact":
        gap, word = ("[^a-z0-9 ]*", kw.lower()) if mode == "default" else ("[^a-z0-9]*", kw.lower().replace(" ", ""))
        folded = match_rows(flat, key, "flat", "lower(strip_accents(flat))", lit(gap.join(word)))
        passes.append(snippet_stages(f"(SELECT *, 2 AS pass FROM ({folded}))"))
    union = " UNION ALL ".join(f"SELECT {key}, pass, i, snippet FROM ({p})" for p in passes)
    return f"""SELECT {key}, list(snippet ORDER BY o) AS snippets FROM (
  SELECT {key}, snippet, o, row_number() OVER (PARTITION BY {key} ORDER BY o) AS k FROM (
    SELECT {key}, snippet, min((pass, i)) AS o FROM ({union}) GROUP BY {key}, snippet)) WHERE k <= {most} GROUP BY {key}"""


def element_inner(clean: str, tag: str) -> str:
    """What stands between the start tag ``tag`` (its first occurrence) and the first end tag of its name up to which there are
    as many end tags as start tags, the own one included; up to the end of the body if there is none."""
    rest = f"regexp_replace(substr({clean}, strpos({clean}, {tag}) + length({tag})), '(?is)</body\\s*>.*$', '')"
    pattern = f"('(?i)</?' || regexp_extract({tag}, '^<([a-zA-Z0-9-]+)', 1) || {lit('(?:>|[' + chr(92) + 's/]' + REST + ')')})"
    walk = "[list_sum([CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END for t in z.tags[1:i]]) for i in range(1, len(z.tags) + 1)]"
    upto = f"coalesce(list_position({walk}, -1), len(z.tags) + 1)"
    joined = f"[array_to_string([z.pieces[k] || CASE WHEN k < e THEN z.tags[k] ELSE '' END for k in range(1, e + 1)], '') for e in [{upto}]][1]"
    return (f"list_transform([{{'pieces': regexp_split_to_array(y.rest, y.p), 'tags': regexp_extract_all(y.rest, y.p)}} "
            f"for y in [{{'rest': {rest}, 'p': {pattern}}}]], lambda z: {joined})[1]")


def main_content_text(x: str) -> str:
    def value(names: str) -> str:
        return f"""\\s*=\\s*(?:(?:"(?:{names})"|'(?:{names})')""" + REST + f"|(?:{names})(?:>|[\\s/]" + REST + "))"

    named = "(?:main|app-root)(?:>|[\\s/]" + REST + ")"
    marked = "[a-z][a-z0-9-]*" + TO_ATTR + "(?:role" + value("main|content") + "|id" + value("app|root|content") + ")"
    clean = strip_non_text(f"regexp_replace({x}, '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g')")
    tag = f"regexp_extract({clean}, {lit('(?is)(<(?:' + named + '|' + marked + '))')}, 1)"
    return markup_to_text(f"(CASE WHEN {tag} <> '' THEN {element_inner(clean, tag)} ELSE {body_html(clean)} END)")


def _extract_links_sql(src: str, with_src: bool = False, with_base_tag: bool = False) -> str:
    raw_base = decode_entities(unquote(f"regexp_extract(_clean, {lit(BASE_TAG)}, 1)")) if with_base_tag else "''"
    plain = "regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)"
    pages = f"""SELECT page_id, url, _a, CASE WHEN len(_a) > 0 THEN list_transform(_a, lambda v: {unquote('v')}) ELSE {plain} END AS _h, _braw FROM (
  SELECT page_id, url, html, regexp_extract_all(_clean, {lit(ANCHOR)}, 1) AS _a, {raw_base} AS _braw FROM {with_clean(src)})"""
    with_page = normalize_stage(f"({pages})", "url", None, "_page")
    with_bres = normalize_stage(f"({with_page})", "_braw", "_page", "_bres", query_fix=True)
    based = f"""SELECT *, CASE WHEN len(_a) > 0 AND _braw <> '' AND _bres <> '' THEN _bres ELSE _page END AS _base FROM ({with_bres})"""
    hrefs = f"""SELECT page_id, _page, _base, generate_subscripts(_h, 1) AS _i, {decode_entities('unnest(_h)')} AS raw FROM ({based})"""
    normed = normalize_stage(f"({hrefs})", "raw", "_base", "link", query_fix=True)
    keep = f"SELECT page_id, _page AS _base, _i, link FROM ({normed}) WHERE link <> '' AND NOT {is_ignored('link')}"
    if with_src:
        return f"""SELECT b._base AS src, d.pos, d.link FROM ({ordered_distinct(f'({keep})', 'page_id', 'link', '_i')}) d
JOIN (SELECT DISTINCT page_id, _base FROM ({keep})) b USING (page_id)"""
    return ordered_distinct(f"({keep})", "page_id", "link", "_i")


def is_spa(x: str) -> str:
    clean = strip_non_text(x)
    tag = "(?is)<html(?:[\\s/][^>]*)?[\\s/](ng-version|data-beasties-container|data-n-head)[\\s=>/]"
    react = "(?is)<[a-z][a-z0-9-]*" + TO_ATTR + "data-reactroot[\\s=>/]"
    nxt = "(?is)<script" + TO_ATTR + "id\\s*=\\s*[\"']?__NEXT_DATA__[\"']?[\\s>/]"
    app_root = f"regexp_extract({clean}, {lit('(?is)(<app-root(?:>|[' + chr(92) + 's/]' + REST + '))')}, 1)"
    root = "(?is)(<div" + TO_ATTR + """id\\s*=\\s*(?:(?:"(?:root|app)"|'(?:root|app)')""" + REST + "|(?:root|app)(?:>|[\\s/]" + REST + ")))"
    root_div = f"regexp_extract({clean}, {lit(root)}, 1)"
    source = "(?is)(<script" + TO_ATTR + "src\\s*=\\s*[\"']?[^\"'>\\s]*[.]js)"
    scripts = f"len(regexp_extract_all({x}, {lit(source)}, 1))"
    blen = f"length({markup_to_text(body_html(clean))})"
    return f"""(regexp_matches({x}, {lit(tag)}) OR regexp_matches({x}, {lit(react)}) OR regexp_matches({x}, {lit(nxt)})
  OR (CASE WHEN {app_root} <> '' THEN length({markup_to_text(element_inner(clean, app_root))}) < 100 ELSE false END)
  OR (CASE WHEN {root_div} <> '' THEN length({markup_to_text(element_inner(clean, root_div))}) < 100 ELSE false END)
  OR ({blen} < 100 AND {scripts} >= 1) OR ({blen} < 300 AND {scripts} >= 2))"""


# ---------------------------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------------------------

_FILES = "(SELECT printf('doc-%08d.txt', doc_id) AS path, strlen(text) AS length, text FROM documents)"
_JSON_MATCH = """CAST(CASE WHEN hp THEN to_json({'page': page::INTEGER, 'line': line::INTEGER, 'count': count::INTEGER, 'snippet': snippet})
    ELSE to_json({'line': line::INTEGER, 'count': count::INTEGER, 'snippet': snippet}) END AS VARCHAR)"""
_TEXT_MATCH = """'  ' || rpad(CASE WHEN hp THEN 'p.' || page || ', l.' || line ELSE 'l.' || line END, 16, ' ') || '  ' ||
    CASE WHEN count = 1 THEN '(1 match)' ELSE '(' || count || ' matches)' END || '  "' || snippet || '"'"""


def _line(section: int, line: str, ord_: str = "0", sub: str = "0", pos: str = "0", first: str = "") -> str:
    return f"SELECT {first}{section} AS section, CAST({ord_} AS BIGINT) AS ord, CAST({sub} AS BIGINT) AS sub, CAST({pos} AS BIGINT) AS pos, {line} AS line"


def _listed(section: int, lines: list[str], rel: str, first: str = "") -> str:
    return " UNION ALL ".join(f"{_line(section, x, str(i), first=first)} FROM {rel} WHERE {x} IS NOT NULL" for i, x in enumerate(lines))


def _report_statements() -> dict[str, str]:
    s: dict[str, str] = {}
    fm = Q.FOLDER_MAX_BYTES

    def ctes(limit: int | None) -> str:
        files = f"(SELECT * FROM {_FILES} WHERE length <= {limit})" if limit else _FILES
        return f"""WITH l AS MATERIALIZED ({grep_lines(files, ['path'], Q.KW_CI, 'default')}),
per AS (SELECT path, CAST(sum(count) AS BIGINT) AS total_matches, bool_or(page > 0) AS hp, row_number() OVER (ORDER BY path) AS rk FROM l GROUP BY path),
m AS (SELECT l.*, hp, rk FROM l JOIN per USING (path)),
st AS (SELECT CAST(count_if(f.length <= {fm}) AS BIGINT) AS files_scanned, CAST(count_if(f.length > {fm}) AS BIGINT) AS files_skipped,
  CAST(0 AS BIGINT) AS files_failed, CAST(count_if(coalesce(per.total_matches, 0) > 0) AS BIGINT) AS files_with_matches,
  CAST(coalesce(sum(per.total_matches), 0) AS BIGINT) AS total_matches FROM {_FILES} f LEFT JOIN per USING (path))
"""

    query = f"'keyword': {lit(Q.KW_CI)}, 'mode': 'default'"
    head = f"CAST(to_json({{'query': {{'file': path, {query}}}, 'stats': {{'total_matches': total_matches}}}}) AS VARCHAR)"
    s["report_json_file"] = ctes(None) + f"{_line(0, head, first='path, ')} FROM per UNION ALL {_line(1, _JSON_MATCH, '0', 'page', 'line', 'path, ')} FROM m"
    titles = ["'--- Results ---'", "'File: ' || path", "'Total matches found: ' || coalesce(total_matches, 0)", "CASE WHEN total_matches > 0 THEN chr(10) || 'Matches:' END"]
    every = f"(SELECT path, total_matches FROM {_FILES} LEFT JOIN per USING (path))"
    s["report_text_file"] = ctes(None) + f"{_listed(0, titles, every, 'path, ')} UNION ALL {_line(1, _TEXT_MATCH, '0', 'page', 'line', 'path, ')} FROM m"

    head = f"""CAST(to_json({{'query': {{'folder': 'documents', {query}}}, 'stats': {{'files_scanned': files_scanned, 'files_skipped': files_skipped,
  'files_failed': files_failed, 'files_with_matches': files_with_matches, 'total_matches': total_matches}}}}) AS VARCHAR)"""
    one = "CAST(to_json({'file': path, 'total_matches': total_matches}) AS VARCHAR)"
    s["report_json_folder"] = ctes(fm) + f"""{_line(0, head)} FROM st UNION ALL {_line(1, one, 'rk')} FROM per
UNION ALL {_line(1, _JSON_MATCH, 'rk', 'page', 'line')} FROM m"""
    summary = ["'--- Results ---'", "'Folder: documents'", "'Files scanned: ' || files_scanned", "CASE WHEN files_skipped > 0 THEN '  Skipped (too large): ' || files_skipped END",
               "CASE WHEN files_failed > 0 THEN '  Failed (unreadable): ' || files_failed END", "'  With matches: ' || files_with_matches", "'Total matches found: ' || total_matches"]
    title = "chr(10) || path || '  (' || total_matches || CASE WHEN total_matches = 1 THEN ' match)' ELSE ' matches)' END"
    s["report_text_folder"] = ctes(fm) + f"""{_listed(0, summary, 'st')} UNION ALL {_line(1, title, 'rk')} FROM per
UNION ALL {_line(1, _TEXT_MATCH, 'rk', 'page', 'line')} FROM m"""

    crawl = f"""WITH {_crawl_ctes()},
err AS (SELECT c.i - 1 AS ord, c.category, c.label, count(o.page_id) AS n FROM (SELECT generate_subscripts(a, 1) AS i, unnest(a) AS category, unnest(b) AS label FROM
   (SELECT {list(CATEGORIES)} AS a, {list(CATEGORY_LABELS)} AS b)) c LEFT JOIN outcomes o ON o.category = c.category GROUP BY ALL),
why AS (SELECT reason, count(*) AS n, row_number() OVER (ORDER BY reason) AS rk FROM outcomes WHERE outcome = 'network_error' GROUP BY reason),
st AS (SELECT CAST(count_if({VISITED}) AS BIGINT) AS v, CAST(count_if(outcome = 'ok') AS BIGINT) AS p, CAST(count_if(outcome = 'ok' AND kind = 'document') AS BIGINT) AS d,
   CAST(count_if(outcome IN ('blocked', 'challenge')) AS BIGINT) AS b, (SELECT CAST(coalesce(sum(count), 0) AS BIGINT) FROM results) AS t FROM outcomes),
blk AS (SELECT page_id, reason, CASE WHEN outcome = 'challenge' THEN _fin.url ELSE o.url END AS url, CASE WHEN outcome = 'challenge' THEN final_url ELSE o.url END AS raw_url
   FROM outcomes o JOIN _fin USING (page_id) WHERE outcome IN ('blocked', 'challenge'))
"""
    errors = ", ".join(f"'{c}': (SELECT n FROM err WHERE category = '{c}')" for c in CATEGORIES)
    head = f"""CAST(to_json({{'query': {{'url': 'fetch_log', 'depth': 1, 'keyword': {lit(Q.KW_PAGES)}, 'mode': 'default'}},
  'stats': {{'total_matches': t, 'pages_visited': v, 'pages_parsed': p, 'docs_parsed': d, 'pages_blocked': b, 'errors': {{{errors}}}}}}}) AS VARCHAR)"""
    reason = "'{\"network_error_reasons\":{' || to_json(reason) || ':' || n || '}}'"
    result = """CAST(CASE WHEN len(snippets) > 0 THEN to_json({'url': url, 'count': count, 'snippets': snippets}) ELSE to_json({'url': url, 'count': count}) END AS VARCHAR)"""
    s["report_json_crawl"] = crawl + f"""{_line(0, head)} FROM st UNION ALL {_line(0, reason, 'rk')} FROM why
UNION ALL {_line(1, result, 'row_number() OVER (ORDER BY count DESC, seq)')} FROM results
UNION ALL {_line(2, "CAST(to_json({'url': url, 'reason': reason}) AS VARCHAR)", 'page_id')} FROM blk"""
    summary = ["'--- Results ---'", "'Total matches found: ' || t", "'Pages visited: ' || v", "'  HTML pages: ' || greatest(p - d, 0)", "'  Documents:  ' || d"]
    found = """list_concat(list_concat(['  ' || url || ' (' || count || ')'], list_transform(snippets, lambda x: '    "' || x || '"')),
  CASE WHEN len(snippets) > 0 AND count > len(snippets) THEN ['    (+ ' || (count - len(snippets)) || ' more)'] ELSE [] END)"""
    blocked = """list_concat(list_concat(['  ' || reason || ' (' || n || '):'], list_transform(urls[1:10], lambda x: '    ' || x)),
  CASE WHEN n > 10 THEN ['    ... and ' || (n - 10) || ' more'] ELSE [] END)"""
    s["report_text"] = crawl + f""", fl AS (SELECT row_number() OVER (ORDER BY count DESC, url) AS rk, {found} AS x FROM results),
bl AS (SELECT row_number() OVER (ORDER BY reason) AS rk, {blocked} AS x FROM (SELECT reason, count(*) AS n, list(raw_url ORDER BY page_id) AS urls FROM blk GROUP BY reason))
{_listed(0, summary, 'st')}
UNION ALL {_line(1, "chr(10) || 'Issues:'")} WHERE EXISTS (SELECT * FROM err WHERE n > 0)
UNION ALL {_line(1, "'  ' || label || ': ' || n", 'ord + 1')} FROM err WHERE n > 0
UNION ALL {_line(1, "'    ' || reason || ': ' || n", '1', 'rk')} FROM why
UNION ALL {_line(2, "chr(10) || 'Found in:'")} WHERE EXISTS (SELECT * FROM results)
UNION ALL SELECT 2, CAST(rk AS BIGINT), CAST(generate_subscripts(x, 1) - 1 AS BIGINT), 0, unnest(x) FROM fl
UNION ALL {_line(3, "chr(10) || 'Blocked / inaccessible:'")} WHERE EXISTS (SELECT * FROM blk)
UNION ALL SELECT 3, CAST(rk AS BIGINT), CAST(generate_subscripts(x, 1) - 1 AS BIGINT), 0, unnest(x) FROM bl"""
    return s


# ---------------------------------------------------------------------------------------------
# crawls, rendered pages, folders
# ---------------------------------------------------------------------------------------------

def _frontier(links: str, seed: str, depth: int) -> str:
    """CTEs: ``queued`` (rank, url, depth, kind) of a breadth-first crawl over ``links`` (src, pos, dst, kind).  Every path is
    walked; the order of a level is that of its paths, step by step documents first, then by position."""
    return f"""_walk(url, depth, path, kind) AS (
  SELECT {seed}, 0, []::BIGINT[], 'nav'
  UNION
  SELECT l.dst, w.depth + 1, list_append(w.path, CASE WHEN l.kind = 'doc' THEN 0 ELSE 1000000 END + l.pos), l.kind
  FROM _walk w JOIN {links} l ON l.src = w.url WHERE w.kind = 'nav' AND (w.depth < {depth} OR l.kind = 'doc')),
_order AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS seq FROM _walk),
{_smart_ctes('_order', '_q')},
queued AS (SELECT row_number() OVER (ORDER BY seq) AS rank, o.url, depth, kind FROM _order o JOIN _qacc USING (seq))"""


def _url_parts(u: str, pre: str) -> str:
    """Scheme-insensitive key, base path, query flag, query tokens and host of the URL column ``u``."""
    key = f"regexp_replace({u}, '^http://', 'https://')"
    q = f"substr({key}, strpos({key}, '?') + 1)"
    tokens = (f"CASE WHEN strpos({key}, '?') = 0 THEN []::VARCHAR[] WHEN {q} = '' THEN [''] WHEN regexp_replace({q}, '&+$', '') = '' THEN []::VARCHAR[] "
              f"ELSE list_distinct(string_split(regexp_replace({q}, '&+$', ''), '&')) END")
    return (f"{key} AS {pre}key, CASE WHEN strpos({key}, '?') > 0 THEN substr({key}, 1, strpos({key}, '?') - 1) ELSE {key} END AS {pre}base, "
            f"strpos({key}, '?') > 0 AS {pre}has, {tokens} AS {pre}params, {url_host(u)} AS {pre}host")


def _crawl_log_ctes(max_pages: int | None, max_hits: int) -> str:
    """The crawls step by step: a row of ``_st`` is the whole state of a crawl (queue, known keys, first token set of every
    base path, counts, scope), and a step takes one link of the present page or, if none is left, one fetch."""
    lim = Q.CRAWL_BYTES
    over = f"(coalesce(TRY_CAST(content_length AS BIGINT) > {lim}, false) OR coalesce(strlen(body) > {lim}, false))"
    text = f"(CASE WHEN {KIND} = 'html' THEN {text_of('_clean')} ELSE body END)"
    reasons = " ".join(f"WHEN {lit(c)} THEN {lit(l)}" for c, l in FAILURES.items())
    judged = f"""SELECT *, {KIND} AS kind, CASE WHEN status IN (403, 429) THEN 'blocked' WHEN status >= 400 OR error_class IS NOT NULL THEN 'network_error'
    WHEN {over} THEN 'skipped_size' WHEN {KIND} = 'html' AND body IS NULL THEN 'parse_error' WHEN {KIND} = 'html' AND {CHALLENGED} THEN 'challenge' ELSE 'ok' END AS outcome,
    {count_default(text, Q.KW_PAGES)} AS c FROM {with_clean('fx_crawl_log', 'body')}"""
    asked = normalize_stage(f"({judged})", "url", None, "_asked")
    got = normalize_stage(f"({asked})", "final_url", None, "_got")
    links = _extract_links_sql("_crawl_pages", with_base_tag=True)
    same = "(CASE WHEN starts_with({0}, 'www.') THEN {1} = substr({0}, 5) OR ends_with({1}, substr({0}, 4)) ELSE {1} = {0} OR {1} = 'www.' || {0} END)"
    def dup(k, base, has, params):
        canon = f"canons[list_position(bases, {base})]"
        return (f"(list_contains(keys, {k}) OR coalesce(CASE WHEN {has} THEN len({canon}) > 0 AND list_has_all({params}, {canon}) ELSE len({canon}) = 0 END, false))")
    limit = f" AND NOT hits >= {max_hits}" if max_hits else ""
    room = f" AND len(queue) - failed < {max_pages}" if max_pages else ""
    failing = "fo IN ('missing', 'blocked', 'network_error')"
    return f"""{FX_CRAWL_LOG},
_judged AS MATERIALIZED ({got}),
_fetch AS MATERIALIZED (SELECT *, {_url_parts('_got', 'e_')} FROM (
  SELECT *, regexp_replace(_asked, '^http://', 'https://') AS key, row_number() OVER (PARTITION BY regexp_replace(_asked, '^http://', 'https://') ORDER BY page_id) AS _n FROM _judged) WHERE _n = 1),
_crawl_pages AS (SELECT page_id, _got AS url, body AS html FROM _fetch WHERE outcome = 'ok' AND kind = 'html'),
_parted AS (SELECT page_id, pos, link, {is_doc('link')} AS doc, {_url_parts('link', 'l_')} FROM ({links})),
_links AS MATERIALIZED (SELECT page_id, list({{'u': link, 'doc': doc, 'k': l_key, 'b': l_base, 'q': l_has, 'p': l_params, 'h': l_host}} ORDER BY doc DESC, pos) AS ls FROM _parted GROUP BY page_id),
_all AS MATERIALIZED (SELECT f.*, coalesce(ls, []) AS ls FROM _fetch f LEFT JOIN _links USING (page_id)),
_seeds AS (SELECT site AS crawl, _asked AS url, {_url_parts('_asked', 's_')} FROM _judged WHERE page_id % 32 = 0),
_st AS (
  SELECT crawl, [{{'u': url, 'k': s_key, 'd': 0}}] AS queue, 0 AS head, [s_key] AS keys, [s_base] AS bases, [s_params] AS canons, 0 AS failed, 0::BIGINT AS hits, s_host AS scope,
    (SELECT any_value(ls) FROM _all WHERE false) AS ls, 0 AS li, 0 AS depth, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, NULL::VARCHAR AS final_url, 0::BIGINT AS count
  FROM _seeds
  UNION ALL
  SELECT crawl, CASE WHEN take THEN list_append(queue, {{'u': x.u, 'k': x.k, 'd': depth + 1}}) ELSE queue END,
    CASE WHEN pop THEN head + 1 ELSE head END,
    CASE WHEN take THEN list_append(keys, x.k) WHEN arrives AND NOT lost THEN list_append(keys, e_key) ELSE keys END,
    CASE WHEN take AND NOT list_contains(bases, x.b) THEN list_append(bases, x.b) WHEN arrives AND NOT lost AND NOT list_contains(bases, e_base) THEN list_append(bases, e_base) ELSE bases END,
    CASE WHEN take AND NOT list_contains(bases, x.b) THEN list_append(canons, x.p) WHEN arrives AND NOT lost AND NOT list_contains(bases, e_base) THEN list_append(canons, e_params) ELSE canons END,
    failed + CASE WHEN pop AND {failing} THEN 1 ELSE 0 END, hits + CASE WHEN pop AND fo = 'ok' AND NOT lost THEN c ELSE 0 END,
    CASE WHEN pop AND head = 0 AND arrives AND NOT lost AND NOT {same.format('scope', 'e_host')} THEN e_host ELSE scope END,
    CASE WHEN pop THEN CASE WHEN fo = 'ok' AND kind = 'html' AND NOT lost THEN fls ELSE [] END ELSE ls END, CASE WHEN pop THEN 0 ELSE li + 1 END, CASE WHEN pop THEN queue[head + 1].d ELSE depth END,
    CASE WHEN pop THEN CASE WHEN lost THEN 'redirect_duplicate' ELSE fo END END,
    CASE WHEN NOT pop OR lost THEN NULL WHEN fo = 'missing' THEN 'Not in the fetch log' WHEN fo = 'blocked' THEN 'HTTP ' || status || ' (Access Denied/Rate Limited)'
      WHEN fo = 'network_error' AND status >= 400 THEN 'HTTP ' || status WHEN fo = 'network_error' THEN CASE error_class {reasons} END
      WHEN fo = 'challenge' THEN 'Cloudflare/Bot protection challenge' END,
    CASE WHEN pop THEN _got END, CASE WHEN pop AND fo = 'ok' AND NOT lost THEN c ELSE 0 END
  FROM (
    SELECT *, arrives AND {dup('e_key', 'e_base', 'e_has', 'e_params')} AS lost,
      NOT pop AND (x.doc OR depth < {Q.CRAWL_DEPTH}) AND {same.format('scope', 'x.h')} AND NOT {dup('x.k', 'x.b', 'x.q', 'x.p')}{room} AS take
    FROM (
      SELECT s.* EXCLUDE (outcome, reason, final_url, count), coalesce(f.outcome, 'missing') AS fo, f.kind, f.c, f.status, f.error_class, f._got, f.ls AS fls, f.e_key, f.e_base, f.e_has, f.e_params, f.e_host,
        coalesce(pop AND f.outcome NOT IN ('blocked', 'network_error') AND f.e_key <> f.key, false) AS arrives
      FROM (SELECT *, li >= coalesce(len(ls), 0) AS pop, ls[li + 1] AS x FROM _st WHERE li < coalesce(len(ls), 0) OR (head < len(queue){limit})) s
      LEFT JOIN _all f ON s.pop AND f.key = s.queue[s.head + 1].k))
), units AS (SELECT crawl, head::BIGINT AS rank, depth::BIGINT AS depth, queue[head].u AS url, final_url, outcome, reason, count FROM _st WHERE outcome IS NOT NULL)"""


def _crawl_statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["crawl_fetch_log"] = f"WITH RECURSIVE {_crawl_log_ctes(None, Q.CRAWL_HITS)}\nSELECT * FROM units"
    limited = f"WITH RECURSIVE {_crawl_log_ctes(Q.LIMITED_PAGES, Q.LIMITED_HITS)}\n"
    s["crawl_fetch_log_limits"] = limited + "SELECT * FROM units"
    s["crawl_log_totals"] = limited + f"""SELECT crawl, count_if({VISITED}) AS pages_visited, count_if(outcome = 'ok') AS pages_parsed,
  count_if(outcome = 'ok' AND ends_with(regexp_replace(url, '[?].*', ''), '.pdf')) AS docs_parsed,
  count_if(outcome IN ('blocked', 'challenge')) AS pages_blocked, count_if(outcome IN ('missing', 'network_error')) AS network_errors,
  sum(count)::BIGINT AS total_matches, CASE WHEN sum(count) >= {Q.LIMITED_HITS} THEN {Q.LIMITED_HITS} ELSE 0 END::BIGINT AS stopped_early FROM units GROUP BY crawl"""
    urls = normalize_stage("pages", "url", None, "u")
    edge_urls = f"""WITH RECURSIVE {FX_EDGES}, _urls AS (SELECT page_id, u FROM ({urls})),
_links AS (SELECT a.u AS src, e.pos, CASE WHEN e.kind = 'doc' THEN b.u || '/file.pdf' ELSE b.u END AS dst, e.kind
  FROM fx_edges e JOIN _urls a ON a.page_id = e.src JOIN _urls b ON b.page_id = e.dst)"""
    seed = "(SELECT u FROM _urls ORDER BY page_id LIMIT 1)"
    s["bfs_rank"] = f"{edge_urls}, {_frontier('_links', seed, 3)} SELECT CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth, kind FROM queued"
    s["max_pages_cut"] = f"{edge_urls}, {_frontier('_links', seed, 5)} SELECT CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth FROM queued WHERE rank <= {Q.MAX_PAGES}"
    site_links = f"""SELECT src, pos, link AS dst, CASE WHEN {is_doc('link')} THEN 'doc' ELSE 'nav' END AS kind FROM ({_extract_links_sql('fx_site', with_src=True)})
  WHERE {in_scope(url_host('link'), 'site.example.com')}"""
    s["crawl_grep"] = f"""WITH RECURSIVE {FX_SITE}, _links AS MATERIALIZED ({site_links}), {_frontier('_links', "'http://site.example.com/0'", 2)},
_c AS MATERIALIZED (SELECT * FROM (SELECT rank, url, depth, _t, {count_default('_t', Q.KW_PAGES)} AS c FROM (SELECT rank, q.url, depth, {text_of('_clean')} AS _t FROM queued q
  JOIN {with_clean('fx_site')} p ON p.url = q.url)) WHERE c > 0),
_sn AS ({find_snippets('_c', 'rank', '_t', Q.KW_PAGES, 'default')})
SELECT CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth, CAST(c AS BIGINT) AS count, coalesce(array_to_string(snippets, chr(10)), '') AS snippets FROM _c LEFT JOIN _sn USING (rank)"""

    seed_host = "(SELECT " + url_host("_nu") + " FROM (" + normalize_stage("(SELECT url FROM pages ORDER BY page_id LIMIT 1)", "url", None, "_nu") + "))"
    first = normalize_stage(f"(SELECT final_url, outcome FROM outcomes WHERE {VISITED} ORDER BY page_id LIMIT 1)", "final_url", None, "_fn")
    s["scope_redirect"] = "WITH " + _outcomes_ctes() + f""", _x AS (SELECT {seed_host} AS seed_host, {url_host('_fn')} AS first_host, outcome FROM ({first})),
_y AS (SELECT *, outcome <> 'redirect_duplicate' AND NOT (CASE WHEN starts_with(seed_host, 'www.') THEN first_host = substr(seed_host, 5) OR ends_with(first_host, substr(seed_host, 4))
    ELSE first_host = seed_host OR first_host = 'www.' || seed_host END) AS moved FROM _x),
_z AS (SELECT *, CASE WHEN moved THEN first_host ELSE seed_host END AS h FROM _y)
SELECT seed_host, first_host, moved, regexp_replace(h, '^www[.]', '') AS scope_root, starts_with(h, 'www.') AS allow_subdomains FROM _z"""

    own = _extract_links_sql("fx_html", with_base_tag=True)
    base = normalize_stage("fx_html", "url", None, "_base")
    rendered = """SELECT page_id, _base, unnest(['/r/' || page_id, '/s.css', '/r/' || page_id, 'mailto:x@y.z', 'files/' || page_id || '.pdf']) AS raw,
  unnest([1, 2, 3, 4, 5]) AS i FROM flags JOIN based USING (page_id) WHERE spa AND page_id % 3 <> 0"""
    r_links = normalize_stage(f"({rendered})", "raw", "_base", "link")
    s["merge_rendered"] = with_(FX_HTML) + f""", own AS MATERIALIZED ({own}), based AS (SELECT page_id, _base FROM ({base})),
flags AS MATERIALIZED (SELECT page_id, {is_spa('html')} AS spa FROM fx_html),
texts AS (SELECT page_id, {text_of('_clean')} AS text FROM {with_clean('fx_html')}),
rl AS (SELECT page_id, link, min(i) AS i, max(i) = 5 AS is_file FROM ({r_links}) WHERE link <> '' AND NOT {is_ignored('link')} GROUP BY page_id, link),
o AS (SELECT page_id, coalesce(string_agg(link, ' ' ORDER BY pos) FILTER (NOT {is_doc('link')}), '') AS nav, coalesce(string_agg(link, ' ' ORDER BY pos) FILTER ({is_doc('link')}), '') AS docs FROM own GROUP BY page_id),
r AS (SELECT page_id, coalesce(string_agg(link, ' ' ORDER BY i) FILTER (NOT is_file), '') AS nav, coalesce(string_agg(link, ' ' ORDER BY i) FILTER (is_file), '') AS docs FROM rl GROUP BY page_id)
SELECT page_id, r.page_id IS NOT NULL AS rendered, CASE WHEN r.page_id IS NOT NULL THEN r.nav ELSE coalesce(o.nav, '') END AS nav_links,
  CASE WHEN r.page_id IS NOT NULL THEN trim(coalesce(o.docs, '') || ' ' || r.docs) ELSE coalesce(o.docs, '') END AS doc_links,
  CASE WHEN r.page_id IS NOT NULL THEN 'rendered text of ' || page_id ELSE text END AS text
FROM texts LEFT JOIN o USING (page_id) LEFT JOIN r USING (page_id)"""
    s["merge_rendered"] = s["merge_rendered"].replace("\n, own AS", ", own AS", 1)

    small = f"(SELECT * FROM documents WHERE strlen(text) + 1 <= {Q.MAX_BYTES})"
    s["folder_scan"] = f"""SELECT doc_id, CAST(sum(count) AS BIGINT) AS total_matches, CAST(count(*) AS BIGINT) AS matching_lines
FROM ({grep_lines(small, ['doc_id'], Q.KW_CI, 'default')}) GROUP BY doc_id"""
    per_file = f"SELECT doc_id, CAST(sum(count) AS BIGINT) AS total_matches FROM ({grep_lines('documents', ['doc_id'], Q.KW_CI, 'default')}) GROUP BY doc_id"
    s["folder_scan_stopped"] = f"""WITH t AS (SELECT *, sum(total_matches) OVER (ORDER BY doc_id) AS upto FROM ({per_file})), k AS (SELECT * FROM t WHERE upto - total_matches < {Q.MAX_HITS}),
e AS (SELECT CASE WHEN max(upto) >= {Q.MAX_HITS} THEN max(doc_id) END AS last FROM k)
SELECT doc_id, total_matches, (SELECT count(*) FROM documents d WHERE last IS NULL OR d.doc_id <= last) AS files_scanned, CASE WHEN last IS NULL THEN 0 ELSE {Q.MAX_HITS} END::BIGINT AS stopped_early FROM k, e"""
    s["sql_grep_lines"] = grep_lines("documents", ["doc_id"], Q.KW_LINES_FUZZY, "fuzzy")
    s["file_scan"] = grep_lines("documents", ["doc_id"], Q.KW_PAGES, "default")
    s["decode_bytes"] = "SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS chars, CAST(strlen(text) + 1 AS BIGINT) AS bytes FROM documents"
    return s
