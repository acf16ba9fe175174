"""URL normalisation, resolution and classification as Column expressions.

``normalize_url(u, base)`` follows the rules of the search tool:
  * ``//host/x`` takes the scheme of the base (https when the base starts with ``https``);
  * a scheme other than http/https gives ``''`` (``javascript:``, ``mailto:``, ``ftp:`` ...);
  * a reference without ``scheme://`` is resolved against the base like ``java.net.URL`` does
    (dot segments removed for relative paths, query-only references keep the base directory,
    fragment-only references keep base path and query); with no usable base it gets ``http://``;
  * scheme and host are lower-cased, the default port dropped, an empty path becomes ``/``,
    ``//`` runs in the path collapse, the fragment is dropped; no host gives ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the search tool's: document suffixes, ignored asset suffixes,
# ignored ad/share hosts and ignored path parts.
DOC_SUFFIXES = (".pdf", ".doc", ".docx", ".txt", ".xlsx", ".odt", ".pptx", ".csv")
IGNORED_SUFFIXES = (
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".otf",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wmv", ".zip", ".rar", ".7z", ".tar.gz",
)
IGNORED_PARTS = (
    "googleads", "doubleclick", "facebook.com/sharer", "twitter.com/intent/tweet", "linkedin.com/share",
    "pinterest.com/pin", "/tag/", "/tags/", "/author/",
)

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
_ABS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _s(v: str) -> Column:
    return F.lit(v)


def _suffix_regex(suffixes) -> str:
    return "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"


def _java_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.``/``..`` segments of an absolute path; ``..`` above the root is kept."""
    return F.element_at(F.transform(F.array(F.split(path, "/")), _dots_of_segments), 1)


def _dots_of_segments(segs: Column) -> Column:
    inner = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    stack = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(
            (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    return F.element_at(
        F.transform(
            F.array(stack),
            lambda st: F.concat(
                _s("/"), F.array_join(st, "/"), F.when(last.isin(".", "..") & (F.size(st) > 0), _s("/")).otherwise(_s(""))
            ),
        ),
        1,
    )


# URL normalisation runs as a chain of ``transform`` stages over structs.  Each stage reads the
# previous stage's fields through a lambda variable, so a value used many times is computed
# once — writing the rules as one nested expression would re-evaluate shared parts
# exponentially often (higher-order functions get no common-subexpression elimination).

def _st_input(x):
    u0 = F.coalesce(_java_trim(x["u"]), _s(""))
    return F.struct(u0.alias("u0"), F.coalesce(x["b"], _s("")).alias("b"), x["qf"].alias("qf"))


def _st_prefix(x):
    u0, b = x["u0"], x["b"]
    u1 = F.when(u0.startswith("//"), F.concat(F.when(b.startswith("https"), _s("https:")).otherwise(_s("http:")), u0)).otherwise(u0)
    return F.struct(u0.alias("u0"), b.alias("b"), x["qf"].alias("qf"), u1.alias("u1"))


def _st_parts(x):
    u1, b = x["u1"], x["b"]
    scheme = F.lower(F.regexp_extract(u1, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    bp = F.regexp_extract(b, _ABS, 3)
    spec = F.when(x["qf"] & u1.startswith("?"), F.concat(bp, u1)).otherwise(u1)
    return F.struct(
        x["u0"].alias("u0"), u1.alias("u1"),
        (u1.rlike(_SCHEME) & ~scheme.isin("http", "https")).alias("bad"),
        u1.rlike(_SCHEME + "//").alias("auth"),
        b.rlike(r"(?i)^https?://").alias("bok"),
        F.regexp_extract(b, _ABS, 1).alias("bs"), F.regexp_extract(b, _ABS, 2).alias("ba"), bp.alias("bp"),
        F.regexp_extract(b, _ABS, 4).alias("bq"),
        F.regexp_extract(spec, r"(?s)^([^#]*)", 1).alias("nf"),
    )


def _st_spec(x):
    nf = x["nf"]
    sp = F.regexp_extract(nf, r"(?s)^([^?]*)", 1)
    merged = F.when(x["bp"] == "", F.concat(_s("/"), sp)).otherwise(F.concat(F.regexp_extract(x["bp"], r"(?s)^(.*/)", 1), sp))
    return F.struct(
        *[x[k].alias(k) for k in ("u0", "u1", "bad", "auth", "bok", "bs", "ba", "bp", "bq")],
        nf.contains("?").alias("hq"), sp.alias("sp"), F.regexp_extract(nf, r"(?s)(\?.*)$", 1).alias("sq"),
        nf.startswith("?").alias("qo"), merged.alias("merged"),
    )


def _st_absolute(x):
    sp, bp = x["sp"], x["bp"]
    path = (
        F.when(sp.startswith("/"), sp)
        .when(sp != "", remove_dot_segments(x["merged"]))
        .when(x["qo"], F.concat(F.regexp_extract(bp, r"(?s)^(.*)/", 1), _s("/")))
        .otherwise(bp)
    )
    query = F.when(x["hq"], x["sq"]).when(sp == "", x["bq"]).otherwise(_s(""))
    u1 = x["u1"]
    prefixed = F.when(u1.startswith("http"), u1).otherwise(F.concat(_s("http://"), u1))
    absolute = F.when(x["auth"], u1).when(x["bok"], F.concat(x["bs"], _s("://"), x["ba"], path, query)).otherwise(prefixed)
    return F.struct(x["u0"].alias("u0"), x["bad"].alias("bad"), absolute.alias("abs"))


def _st_canon_parts(x):
    a = x["abs"]
    return F.struct(
        x["u0"].alias("u0"), x["bad"].alias("bad"), a.rlike(_ABS).alias("ok"),
        F.lower(F.regexp_extract(a, _ABS, 1)).alias("proto"),
        F.regexp_extract(F.regexp_extract(a, _ABS, 2), r"(?s)^(?:[^@]*@)?(.*)$", 1).alias("hp"),
        F.regexp_extract(a, _ABS, 3).alias("path"), F.regexp_extract(a, _ABS, 4).alias("query"),
    )


def _st_host(x):
    hp = x["hp"]
    return F.struct(
        *[x[k].alias(k) for k in ("u0", "bad", "ok", "proto", "path", "query")],
        F.lower(F.regexp_extract(hp, r"(?s)^([^:]*)", 1)).alias("host"),
        F.regexp_extract(hp, r"(?s)^[^:]*:(.*)$", 1).alias("port"),
    )


def _st_port(x):
    port = x["port"]
    port_n = F.when(port == "", F.lit(-1)).otherwise(port.try_cast("int"))
    return F.struct(
        *[x[k].alias(k) for k in ("u0", "bad", "ok", "proto", "path", "query", "host")],
        ((port == "") | port.rlike(r"^[0-9]{1,9}$")).alias("port_ok"), port_n.alias("port_n"),
    )


def _st_output(x):
    proto, port_n = x["proto"], x["port_n"]
    default_port = F.when(proto == "https", F.lit(443)).otherwise(F.lit(80))
    port_txt = F.when((port_n != -1) & (port_n != default_port), F.concat(_s(":"), port_n.cast("string"))).otherwise(_s(""))
    p = F.regexp_replace(F.when(x["path"] == "", _s("/")).otherwise(x["path"]), "/{2,}", "/")
    good = x["ok"] & proto.isin("http", "https") & (x["host"] != "") & x["port_ok"]
    canon = F.when(good, F.concat(proto, _s("://"), x["host"], port_txt, p, x["query"])).otherwise(_s(""))
    return F.when((x["u0"] == "") | x["bad"], _s("")).otherwise(canon)


_STAGES = (_st_prefix, _st_parts, _st_spec, _st_absolute, _st_canon_parts, _st_host, _st_port, _st_output)


def normalize_url_structs(items: Column) -> Column:
    """Array of struct(u, b, qf) -> array of normalised URLs (see module doc)."""
    arr = F.transform(items, _st_input)
    for st in _STAGES:
        arr = F.transform(arr, st)
    return arr



def normalize_url(u, base=None, query_fix: bool = False) -> Column:
    """Canonical http(s) URL or ``''``.  ``query_fix`` keeps the base path for ``?query``
    references (the HTML link resolver's behaviour) instead of the base directory."""
    b = _col(base) if base is not None else _s("")
    item = F.struct(_col(u).alias("u"), b.alias("b"), F.lit(bool(query_fix)).alias("qf"))
    return F.element_at(normalize_url_structs(F.array(item)), 1)


def url_host(u) -> Column:
    """Lower-case host of an absolute URL, ``''`` when it has none."""
    u = F.coalesce(_col(u), _s(""))
    auth = F.regexp_extract(u, _ABS, 2)
    hostport = F.regexp_extract(auth, r"(?s)^(?:[^@]*@)?(.*)$", 1)
    return F.lower(F.regexp_extract(hostport, r"(?s)^([^:]*)", 1))


def _path_only_lower(u: Column) -> Column:
    low = F.lower(F.coalesce(u, _s("")))
    return F.regexp_extract(low, r"(?s)^([^#?]*)", 1)


def is_document_link(u) -> Column:
    return _path_only_lower(_col(u)).rlike(_suffix_regex(DOC_SUFFIXES))


def is_ignored_link(u) -> Column:
    p = _path_only_lower(_col(u))
    parts = "(" + "|".join(x.replace(".", r"\.") for x in IGNORED_PARTS) + ")"
    return ~is_document_link(u) & (p.rlike(_suffix_regex(IGNORED_SUFFIXES)) | p.rlike(parts))



def scheme_key(u) -> Column:
    """Scheme-insensitive dedup key: ``http://`` becomes ``https://``."""
    u = _col(u)
    return F.when(u.startswith("http://"), F.concat(_s("https://"), F.substring(u, 8, 1 << 30))).otherwise(u)


def scope_root(seed_host) -> Column:
    h = _col(seed_host)
    return F.when(h.startswith("www."), F.substring(h, 5, 1 << 30)).otherwise(h)


def in_scope(link_host, seed_host) -> Column:
    """Seed ``www.x`` admits ``x`` and every subdomain of it; otherwise only ``x`` and ``www.x``."""
    h = F.lower(_col(link_host))
    s = _col(seed_host)
    root = scope_root(s)
    return F.when(s.startswith("www."), (h == root) | h.endswith(F.concat(_s("."), root))).otherwise(
        (h == root) | (h == F.concat(_s("www."), root))
    )
