"""SQL-callable versions of the core functions, registered as SQL-bodied temporary functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expression>``).  Their bodies are plain Spark SQL, so
Catalyst inlines them into the calling plan like any other expression — no Python at runtime.

    register(spark)
    spark.sql("SELECT doc_id, count_matches(text, 'café', 'default') FROM documents")
    spark.sql("SELECT doc_id, m.* FROM (SELECT doc_id, line_matches(text, 'café', 'default') AS found FROM documents) LATERAL VIEW explode(found) AS m")

Functions of rows return arrays that a LATERAL VIEW unfolds in the same task; functions that return tables would make
Spark join their rows back on the whole text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from trawl.functions.text import fold_table


def _sql_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bodies() -> dict[str, tuple[str, str, str]]:
    src, dst = fold_table()

    def unmark(x):
        return f"lower(regexp_replace(translate({x}, {_sql_lit(src)}, {_sql_lit(dst)}), '\\\\p{{M}}', ''))"

    def fold_strict(x):
        return f"regexp_replace({unmark(x)}, '[^a-z0-9]', '')"

    def fold_spaces(x):
        return f"regexp_replace({unmark(x)}, '[^a-z0-9]+', ' ')"

    def count_lit(t, k):
        return f"coalesce(cast(floor((length({t}) - length(replace({t}, {k}, ''))) / length({k})) as int), 0)"

    quoted = "concat('\\\\Q', replace(k, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    special = "k rlike '[\\\\x00-\\\\x1F\\\\x21-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]'"
    sk_sp = f"trim({fold_spaces('k')})"
    sk = fold_strict("k")
    th = f"(CASE WHEN length({sk}) <= 4 THEN 1 ELSE 2 END)"

    def counts(t):
        """SQL of the exact, default and fuzzy count of keyword ``k`` in the text ``t``."""
        ci = f"coalesce(regexp_count({t}, concat('(?iu)', {quoted})), 0)"
        default = (f"CASE WHEN {t} IS NULL OR k IS NULL OR k = '' THEN 0 "
                   f"WHEN {special} OR length({sk_sp}) < 2 THEN {ci} "
                   f"ELSE greatest({ci}, {count_lit(fold_spaces(t), sk_sp)}) END")
        words = (f"size(filter(split({fold_spaces(t)}, ' '), w -> w <> '' AND abs(length(w) - length({sk})) <= {th} "
                 f"AND levenshtein(w, {sk}, {th}) >= 0))")
        fuzzy = (f"CASE WHEN {t} IS NULL OR k IS NULL OR length({sk}) < 2 THEN 0 "
                 f"WHEN {count_lit(fold_strict(t), sk)} > 0 THEN {count_lit(fold_strict(t), sk)} ELSE coalesce({words}, 0) END")
        return f"CASE WHEN {t} IS NULL OR k IS NULL OR k = '' THEN 0 ELSE {count_lit(t, 'k')} END", default, fuzzy

    def by_mode(t):
        exact, default, fuzzy = counts(t)
        return (f"CASE mode WHEN 'exact' THEN ({exact}) WHEN 'fuzzy' THEN ({fuzzy}) WHEN 'default' THEN ({default}) "
                "ELSE raise_error(concat('unknown mode ', coalesce(mode, 'null'))) END")

    exact, default, fuzzy = counts("t")
    plain = ("regexp_replace(regexp_replace(l, '^[\\\\x00-\\\\x20]+|[\\\\x00-\\\\x20]+$', ''), '[\\\\x00-\\\\x1F\\\\x7F]', '')")
    snippet = f"CASE WHEN length({plain}) > 120 THEN concat(substring({plain}, 1, 117), '...') ELSE {plain} END"
    pages = "split(regexp_replace(t, '\\r\\n?', '\\n'), chr(12), -1)"
    line = f"named_struct('page', CASE WHEN instr(t, chr(12)) > 0 THEN i + 1 ELSE 0 END, 'line', j + 1, 'text', l, 'count', {by_mode('l')})"
    counted = f"filter(flatten(transform({pages}, (p, i) -> transform(split(p, '\\n', -1), (l, j) -> {line}))), m -> m.count > 0)"
    matches = f"transform({counted}, m -> named_struct('page', m.page, 'line', m.line, 'count', m.count, 'snippet', {snippet.replace('(l,', '(m.text,')}))"
    return {
        "normalize_url": ("u STRING, b STRING", "STRING", _normalize_url_sql()),
        "fold_strict": ("x STRING", "STRING", fold_strict("x")),
        "fold_spaces": ("x STRING", "STRING", fold_spaces("x")),
        "count_exact": ("t STRING, k STRING", "INT", exact),
        "count_default": ("t STRING, k STRING", "INT", default),
        "count_fuzzy": ("t STRING, k STRING", "INT", fuzzy),
        "count_matches": (
            "t STRING, k STRING, mode STRING", "INT",
            by_mode("t"),
        ),
        "line_matches": ("t STRING, k STRING, mode STRING", "ARRAY<STRUCT<page: INT, line: INT, count: INT, snippet: STRING>>", matches),
        "url_scheme_key": ("u STRING", "STRING",
                           "CASE WHEN startswith(u, 'http://') THEN concat('https://', substring(u, 8)) ELSE u END"),
    }


def _normalize_url_sql() -> str:
    """The staged URL normalisation of :mod:`trawl.functions.urls`, written as SQL ``transform``
    stages over ``named_struct`` values (each stage reads the previous one's fields)."""
    from trawl.functions.urls import _ABS, _SCHEME

    q = _sql_lit
    a = q(_ABS)

    def keep(*names):
        return ", ".join(f"'{n}', x.{n}" for n in names)

    dots = (
        "element_at(transform(array(split(x.merged, '/')), segs -> element_at(transform(array(aggregate("
        "slice(segs, 2, greatest(size(segs) - 1, 0)), cast(array() as array<string>), (acc, s) -> "
        "CASE WHEN s = '.' THEN acc WHEN s = '..' AND size(acc) > 0 AND element_at(acc, -1) != '..' "
        "THEN slice(acc, 1, greatest(size(acc) - 1, 0)) ELSE concat(acc, array(s)) END)), st -> "
        "concat('/', array_join(st, '/'), CASE WHEN element_at(segs, -1) IN ('.', '..') AND size(st) > 0 "
        "THEN '/' ELSE '' END)), 1)), 1)"
    )
    stages = [
        f"x -> named_struct({keep('u0', 'b')}, 'u1', CASE WHEN startswith(x.u0, '//') THEN concat(CASE WHEN "
        "startswith(x.b, 'https') THEN 'https:' ELSE 'http:' END, x.u0) ELSE x.u0 END)",
        f"x -> named_struct({keep('u0', 'u1')}, 'bad', x.u1 rlike {q(_SCHEME)} AND lower(regexp_extract(x.u1, "
        f"{q('^([a-zA-Z][a-zA-Z0-9+.-]*):')}, 1)) NOT IN ('http', 'https'), 'auth', x.u1 rlike {q(_SCHEME + '//')}, "
        f"'bok', x.b rlike {q('(?i)^https?://')}, 'bs', regexp_extract(x.b, {a}, 1), 'ba', regexp_extract(x.b, {a}, 2), "
        f"'bp', regexp_extract(x.b, {a}, 3), 'bq', regexp_extract(x.b, {a}, 4), 'nf', regexp_extract(x.u1, {q('(?s)^([^#]*)')}, 1))",
        f"x -> named_struct({keep('u0', 'u1', 'bad', 'auth', 'bok', 'bs', 'ba', 'bp', 'bq')}, 'hq', contains(x.nf, '?'), "
        f"'sp', regexp_extract(x.nf, {q('(?s)^([^?]*)')}, 1), 'sq', regexp_extract(x.nf, {q('(?s)(\\?.*)$')}, 1), "
        f"'qo', startswith(x.nf, '?'), 'merged', CASE WHEN x.bp = '' THEN concat('/', regexp_extract(x.nf, {q('(?s)^([^?]*)')}, 1)) "
        f"ELSE concat(regexp_extract(x.bp, {q('(?s)^(.*/)')}, 1), regexp_extract(x.nf, {q('(?s)^([^?]*)')}, 1)) END)",
        f"x -> named_struct({keep('u0', 'bad')}, 'abs', CASE WHEN x.auth THEN x.u1 WHEN x.bok THEN concat(x.bs, '://', x.ba, "
        f"CASE WHEN startswith(x.sp, '/') THEN x.sp WHEN x.sp != '' THEN {dots} WHEN x.qo THEN concat(regexp_extract(x.bp, "
        f"{q('(?s)^(.*)/')}, 1), '/') ELSE x.bp END, CASE WHEN x.hq THEN x.sq WHEN x.sp = '' THEN x.bq ELSE '' END) "
        "WHEN startswith(x.u1, 'http') THEN x.u1 ELSE concat('http://', x.u1) END)",
        f"x -> named_struct({keep('u0', 'bad')}, 'ok', x.abs rlike {a}, 'proto', lower(regexp_extract(x.abs, {a}, 1)), "
        f"'hp', regexp_extract(regexp_extract(x.abs, {a}, 2), {q('(?s)^(?:[^@]*@)?(.*)$')}, 1), 'path', regexp_extract(x.abs, {a}, 3), "
        f"'query', regexp_extract(x.abs, {a}, 4))",
        f"x -> named_struct({keep('u0', 'bad', 'ok', 'proto', 'path', 'query')}, 'host', lower(regexp_extract(x.hp, {q('(?s)^([^:]*)')}, 1)), "
        f"'port', regexp_extract(x.hp, {q('(?s)^[^:]*:(.*)$')}, 1))",
        f"x -> named_struct({keep('u0', 'bad', 'ok', 'proto', 'path', 'query', 'host')}, 'port_ok', x.port = '' OR x.port rlike "
        f"{q('^[0-9]{1,9}$')}, 'port_n', CASE WHEN x.port = '' THEN -1 ELSE try_cast(x.port AS INT) END)",
        "x -> CASE WHEN x.u0 = '' OR x.bad THEN '' WHEN x.ok AND x.proto IN ('http', 'https') AND x.host != '' AND x.port_ok "
        "THEN concat(x.proto, '://', x.host, CASE WHEN x.port_n != -1 AND x.port_n != CASE WHEN x.proto = 'https' THEN 443 ELSE 80 END "
        f"THEN concat(':', cast(x.port_n AS STRING)) ELSE '' END, regexp_replace(CASE WHEN x.path = '' THEN '/' ELSE x.path END, "
        f"{q('/{2,}')}, '/'), x.query) ELSE '' END",
    ]
    arr = f"array(named_struct('u0', coalesce(regexp_replace(u, {q('^[\\x00-\\x20]+|[\\x00-\\x20]+$')}, ''), ''), 'b', coalesce(b, '')))"
    for st in stages:
        arr = f"transform({arr}, {st})"
    return f"element_at({arr}, 1)"


def register(spark: SparkSession) -> list[str]:
    names = []
    for name, (params, ret, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
