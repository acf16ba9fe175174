"""Line, page and multi-keyword grep over text tables.

All jobs are narrow (generate + project + filter) until a caller groups; nothing is collected.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import keyword_scan as KS
from trawl.session import ensure_checkpoint_dir, ship_code


def _ids(id_cols) -> list[str]:
    return [id_cols] if isinstance(id_cols, str) else list(id_cols)


def normalize_newlines(c) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(T._col(c), "\r\n?", "\n")


def with_computed(df: DataFrame, keep: Sequence[str], **cols: Column) -> DataFrame:
    """``keep`` columns plus ``cols`` computed inside a one-element generator.

    A later filter on these columns cannot be pushed below the generator, so an expensive
    expression (a match count over a whole document) is evaluated once, after any upstream
    repartition, instead of being copied into a filter that Catalyst would push down to the
    scan side of the shuffle."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select(*keep, F.inline(packed))


def split_lines(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] | str = ("doc_id",)) -> DataFrame:
    """One row per line: ``page`` is 1-based when the text has form feeds, else 0; ``line``
    restarts at 1 on every page."""
    ids = _ids(id_cols)
    normed = with_computed(df, ids, _norm=normalize_newlines(text_col))
    paged = normed.select(
        *ids,
        F.instr("_norm", "\f").alias("_ff"),
        F.posexplode(F.split("_norm", "\f", -1)).alias("_p", "_page_text"),
    )
    return paged.select(
        *ids,
        F.when(F.col("_ff") > 0, F.col("_p") + 1).otherwise(F.lit(0)).cast("int").alias("page"),
        F.posexplode(F.split("_page_text", "\n", -1)).alias("_l", "line_text"),
    ).select(*ids, "page", (F.col("_l") + 1).cast("int").alias("line"), "line_text")


def grep_lines(
    df: DataFrame,
    keyword: str,
    mode: str = "default",
    text_col: str = "text",
    id_cols: Sequence[str] | str = ("doc_id",),
) -> DataFrame:
    """(ids..., page, line, count, snippet) for every line with at least one match."""
    ids = _ids(id_cols)
    lines = split_lines(df, text_col, ids)
    counted = with_computed(lines, [*ids, "page", "line", "line_text"], count=T.count_matches("line_text", keyword, mode))
    return counted.filter(F.col("count") > 0).select(
        *ids, "page", "line", "count", T.line_snippet("line_text").alias("snippet")
    )


def multi_keyword_grep(
    df: DataFrame,
    keywords: Sequence[tuple[str, str]],
    text_col: str = "text",
    id_cols: Sequence[str] | str = ("doc_id",),
    with_snippet: bool = True,
) -> DataFrame:
    """Many (keyword, mode) searches in one scan: every line gets an array of per-keyword
    counts that is exploded and filtered — no join, no rescan per keyword.  The keyword list is
    part of the plan, so this is for the few keywords of one search, on tables and streams alike;
    :func:`keyword_table_grep` takes keyword tables of any size."""
    ids = _ids(id_cols)
    lines = split_lines(df, text_col, ids)
    # the folds are computed once per line in their own projection and shared by every keyword
    folded = lines.select(*ids, "page", "line", "line_text", T.fold_spaces("line_text").alias("_fs"),
                          T.fold_strict("line_text").alias("_fst"))
    counts = F.array(
        *[
            F.struct(F.lit(k).alias("keyword"), F.lit(m).alias("mode"),
                     T.count_matches("line_text", k, m, folded_strict="_fst", folded_spaces="_fs").alias("count"))
            for k, m in keywords
        ]
    )
    exploded = folded.select(*ids, "page", "line", "line_text", F.inline(counts))
    out = exploded.filter(F.col("count") > 0)
    cols = [*ids, "keyword", "mode", "page", "line", "count"]
    if with_snippet:
        return out.select(*cols, T.line_snippet("line_text").alias("snippet"))
    return out.select(*cols)


GRAM = 3  # code points of the grams that lines and keywords are joined on
#: Keyword tables with no more rows than this are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_KEYWORDS = 200_000


@functools.lru_cache(maxsize=1)
def _case_table() -> tuple[str, str]:
    """Characters and the form that case-insensitive regexes compare them by: upper, then lower, one code point to one."""
    found = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        upper = c.upper()
        lower = (upper if len(upper) == 1 else c).lower()
        if lower[0] != c:
            found[c] = lower[0]  # the one lower form of two code points starts with its plain letter
    return "".join(found), "".join(found.values())


def _casefold(c: Column) -> Column:
    """A form that is equal for exactly the texts that a case-insensitive literal takes as equal."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, *_case_table()))


def _grams(c: Column, space: str, lengths: Sequence[int]) -> Column:
    """Distinct grams of the given lengths, marked with the form of the text they are from.  A lookahead cuts them in one pass
    over the text; ``substr`` would count from its start for each."""
    cuts = [F.regexp_extract_all(c, F.lit("(?s)(?=(%s))" % ("." * n)), 1) for n in lengths]
    return F.transform(F.array_distinct(F.concat(*cuts)), lambda g: F.concat(F.lit(space), g))


def _middle_gram(c: Column, space: str) -> Column:
    """One gram of a keyword: its middle ``GRAM`` code points, or all of a shorter one."""
    start = F.greatest(F.floor((F.length(c) - GRAM) / 2).cast("int"), F.lit(0)) + 1
    return F.concat(F.lit(space), F.substr(c, start, F.lit(GRAM)))


def _without(c: Column, times: int) -> Column:
    """``c`` and what is left of it after deleting up to ``times`` characters."""
    out = F.array(c)
    for _ in range(times):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: i <= F.length(w)),
            lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


SHORT = 12  # folded keywords up to this length are met by deletions, longer ones by segments
EDITS = 2


def _segment(n: Column, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the k-th of the ``EDITS`` + 1 segments of a word of length ``n``."""
    part = F.floor(n / (EDITS + 1)).cast("int")
    return part * k, (n - part * EDITS if k == EDITS else part)


def _keyword_marks(c: Column) -> Column:
    """Keys that a folded keyword shares with every word within ``EDITS`` edits of it: what few deletions leave of a short one; of
    a long one its segments, one of which the edits have left whole."""
    n = F.length(c)
    segments = []
    for k in range(EDITS + 1):
        start, size = _segment(n, k)
        segments.append(F.concat_ws(":", F.lit("s"), n.cast("string"), F.lit(str(k)), F.substr(c, start + 1, size)))
    return F.when(n <= SHORT, F.transform(_without(c, EDITS), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array(*segments))


def _word_marks(c: Column) -> Column:
    """The keys of a word: for every keyword length within ``EDITS``, each segment's place shifted by up to ``EDITS`` characters; their
    number does not depend on the word's length."""
    m = F.length(c)
    lengths = F.filter(F.sequence(m - EDITS, m + EDITS), lambda n: n > SHORT)

    def of_length(n):
        def places(k):
            start, size = _segment(n, k)
            shifts = F.filter(F.sequence(start - EDITS, start + EDITS), lambda at: (at >= 0) & (at + size <= m))
            return F.transform(shifts, lambda at: F.concat_ws(":", F.lit("s"), n.cast("string"), F.lit(str(k)), F.substr(c, at + 1, size)))

        return F.concat(*[places(k) for k in range(EDITS + 1)])

    deleted = F.when(m <= SHORT + EDITS, F.transform(_without(c, EDITS), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(deleted, F.flatten(F.transform(lengths, of_length))))


def keyword_forms(keywords: DataFrame) -> DataFrame:
    """Distinct (keyword, mode) with what the modes compare: folded forms, threshold, whether the fold is used."""
    k = keywords.select("keyword", "mode").filter((F.col("keyword") != "") & F.col("mode").isin(*T.MODES)).distinct()
    special = F.col("keyword").rlike(r"[\x00-\x7F&&[^a-zA-Z0-9 ]]")
    x = k.withColumn("_ks", F.trim(T.fold_spaces("keyword"))).withColumn("_kt", T.fold_strict("keyword"))
    return x.select(
        "keyword", "mode", "_ks", "_kt", F.when(F.length("_kt") <= 4, 1).otherwise(2).alias("_t"),
        ((F.col("mode") == "default") & ~special & (F.length("_ks") >= 2)).alias("_folds"), _casefold(F.col("keyword")).alias("_kc"),
    ).filter((F.col("mode") != "fuzzy") | (F.length("_kt") >= 2))


def _literal_count(c: Column, needle: Column) -> Column:
    """Occurrences by bytes, which are known without a pass over the text."""
    return F.floor((F.octet_length(c) - F.octet_length(F.replace(c, needle, F.lit("")))) / F.octet_length(needle)).cast("int")


def _by_mode(exact, default, folded, fuzzy) -> Column:
    """What ``line_text`` and the keyword of the row give, by its mode: ``default`` of the case-folded forms and, where the keyword
    folds, ``folded`` of that and the spaced ones; for fuzzy ones the folded occurrences."""
    ci = default(F.col("_cf"), F.col("_kc"))
    return (
        F.when(F.col("mode") == "exact", exact(F.col("line_text"), F.col("keyword")))
        .when(F.col("mode") == "fuzzy", fuzzy(F.col("_fst"), F.col("_kt")))
        .when(F.col("_folds"), folded(ci, default(F.col("_fs"), F.col("_ks"))))
        .otherwise(ci)
    )


def _is_inside() -> Column:
    return _by_mode(F.contains, F.contains, lambda a, b: a | b, F.contains)


def _count_inside() -> Column:
    return _by_mode(_literal_count, _literal_count, F.greatest, _literal_count)


#: Up to this many fuzzy keywords are compared with every word; more meet the words on shared marks.
LOOP_KEYWORDS = 10_000
LINE_TASK_BYTES = 1 << 20  # bytes of text whose lines a task searches for the keywords of a table
#: Near words that are sent to every executor, with a tenth for each keyword of one; more meet the lines by a shuffle.
NEAR_WORDS = 1_000_000


def _letters(c: Column) -> Column:
    """The letters and digits of a folded word, and the letters that it has twice, as bits."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    once = [F.contains(c, F.lit(x)) for x in letters + "0123456789"]
    twice = [F.call_function("locate", F.lit(x), c, F.instr(c, x) + 1) > 0 for x in letters]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(once + twice)])


def _lacks(a: str, b: str) -> Column:
    """How many of the letters of ``a`` ``b`` lacks; each edit adds and removes one at most."""
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))


def _near_words(lines: DataFrame, fuzzy: DataFrame, send, tasks: int) -> DataFrame:
    """(word, _kids): distinct words of the lines with the fuzzy keywords that they are within the edit bound of."""
    count, least, most = fuzzy.agg(F.count(F.lit(1)), F.min(F.length("_kt")), F.max(F.length("_kt"))).first()
    like = F.length("word").between(least - EDITS, most + EDITS)  # others are too short or too long for any
    words = lines.select(F.explode(F.split(T.fold_spaces("line_text"), " ")).alias("word")).filter((F.col("word") != "") & like).distinct()
    within = F.pmod(F.levenshtein(F.col("word"), F.col("_kt"), EDITS), F.lit(EDITS + 2)) <= F.col("_t")  # -1: more than EDITS
    if count <= LOOP_KEYWORDS:
        left = words.select("word", F.length("word").alias("_size"), _letters(F.col("word")).alias("_has")).repartition(tasks, "word")
        sizes = F.sequence(F.length("_kt") - F.col("_t"), F.length("_kt") + F.col("_t"))
        right = fuzzy.select("_kid", "_kt", "_t", _letters(F.col("_kt")).alias("_had"), F.explode(sizes).alias("_size"))
        near = left.join(F.broadcast(right), "_size").filter((_lacks("_has", "_had") <= F.col("_t")) & (_lacks("_had", "_has") <= F.col("_t")) & within)
        near = near.select("word", "_kid")
    else:
        left = words.repartition(tasks, "word").select("word", F.explode(_word_marks(F.col("word"))).alias("mark"))
        right = fuzzy.select("_kid", "_kt", "_t", F.explode(_keyword_marks(F.col("_kt"))).alias("mark"))
        near = left.join(send(right), "mark").filter(within).select("word", "_kid").distinct()
    return near.groupBy("word").agg(F.collect_list("_kid").alias("_kids"))


def _scanned(lines: DataFrame, place: Sequence[str], k: DataFrame, near: DataFrame | None) -> DataFrame:
    """(place..., _snippet, _kid, count) of lines with their forms and ``_times``, searched by tasks that hold the whole keyword
    table and, if given, the near words; the driver collects both, so they are bounded by the caller."""
    ship_code(lines.sparkSession)
    text = [F.col(c).cast("binary").alias(c) for c in ("keyword", "_kc", "_ks", "_kt")]
    rows = k.select("_kid", "mode", "_folds", *text).collect()
    table = [(r["_kid"], r["mode"], bytes(r["keyword"]), bytes(r["_kc"]), bytes(r["_ks"]) if r["_folds"] else None, bytes(r["_kt"])) for r in rows]
    words = None
    if near is not None:
        got = near.select(F.col("word").cast("binary").alias("word"), "_kids").toArrow()
        kids = got["_kids"].combine_chunks()
        words = got["word"].to_pylist(), kids.value_lengths().to_numpy(), kids.flatten().to_numpy()
    sent = lines.sparkSession.sparkContext.broadcast(KS.KeywordScan(table, words))
    scan = F.arrow_udf(KS.scanner(sent), KS.HITS).asNondeterministic()  # else it also runs in a filter that Spark derives
    hits = scan(*[F.col(c).cast("binary") for c in ("line_text", "_cf", "_fs", "_fst")], F.col("_times"))
    return lines.select(*place, "_snippet", hits.alias("_hits")).select(*place, "_snippet", F.inline("_hits"))


def keyword_table_grep(df: DataFrame, keywords: DataFrame, text_col: str = "text", id_cols: Sequence[str] | str = ("doc_id",)) -> DataFrame:
    """(ids..., keyword, mode, page, line, count, snippet) for every line and every keyword of a table (keyword, mode)
    with a match; the plan does not grow with the table.

    Lines are dealt to tasks by their place and searched there for the whole table (:mod:`trawl.operators.keyword_scan`); only a
    table of more than ``BROADCAST_KEYWORDS`` rows is joined by a shuffle, of narrow rows first: a line that holds a keyword has
    the keyword's middle gram, in the form that the mode compares.  A fuzzy keyword that a line does not hold
    counts its near words: those are found once for the distinct words of the corpus, and meet the lines' words in the same step or,
    above ``NEAR_WORDS``, by a shuffle.  ``id_cols`` identify rows."""
    ids = _ids(id_cols)
    ensure_checkpoint_dir(df.sparkSession)
    k = keyword_forms(keywords).withColumn("_kid", F.monotonically_increasing_id()).checkpoint()
    small = k.count() <= BROADCAST_KEYWORDS
    send = F.broadcast if small else (lambda x: x)
    tasks = (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // LINE_TASK_BYTES + 1
    place = [*ids, "page", "line", "_hash"]
    split = split_lines(df, text_col, ids).filter(F.col("line_text") != "")
    dealt = split.withColumn("_hash", F.xxhash64("line_text")).repartition(tasks, *place)

    def with_forms(lines, also=()):  # once per line
        lines = with_computed(lines, [*place, *also, "line_text"], _unmarked=T.unmark_lower("line_text"), _cf=_casefold(F.col("line_text")))
        return with_computed(lines, [*place, *also, "line_text", "_cf"], _fs=T.spaced("_unmarked"), _fst=T.strict("_unmarked"), _snippet=T.line_snippet("line_text"))

    fuzzy = k.filter(F.col("mode") == "fuzzy").select("_kid", "_kt", "_t")
    near = None if fuzzy.isEmpty() else _near_words(split, fuzzy, send, tasks).checkpoint()
    numbers = [*place, "_snippet"]
    if small:
        near_sent = near is not None and near.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("_kids")), F.lit(0)) / 10).first()[0] <= NEAR_WORDS
        distinct = dealt.groupBy(*place, "line_text").agg(F.count(F.lit(1)).alias("_times"))
        counted = _scanned(with_forms(distinct, ["_times"]), place, k, near if near_sent else None)
        found = counted.select(*numbers, "_kid", F.col("count").alias("inside"), F.lit(False).alias("near"))
    else:
        near_sent = False
        found = _joined(with_forms(dealt), place, k)
    if near is not None and not near_sent:
        words = with_computed(with_forms(dealt), numbers, _words=F.split("_fs", " ")).select(*numbers, F.explode("_words").alias("word")).join(near, "word")
        found = found.unionByName(words.select(*numbers, F.explode("_kids").alias("_kid"), F.lit(None).cast("int").alias("inside"), F.lit(True).alias("near")))
    if not small or near is not None and not near_sent:
        # Near words count where the line does not hold the keyword; a line that comes twice is two matches of a keyword it holds.
        summed = found.groupBy(*numbers, "_kid").agg(F.count("inside").cast("int").alias("_times"), F.max("inside").alias("_inside"), F.count_if("near").cast("int").alias("_near"))
        copies = F.array_repeat(F.coalesce("_inside", "_near"), F.greatest("_times", F.lit(1)))
        counted = summed.select(*numbers, "_kid", F.explode(copies).alias("count"))
    return counted.join(send(k.select("_kid", "keyword", "mode")), "_kid").select(*ids, "keyword", "mode", "page", "line", "count", F.col("_snippet").alias("snippet"))


def _joined(lines: DataFrame, place: Sequence[str], k: DataFrame) -> DataFrame:
    """(place..., _snippet, _kid, inside, near): the keywords that lines hold, met by grams in a shuffle."""
    literal = _middle_gram(F.col("_kc"), "c")
    grams = F.array_compact(F.array(
        F.when(F.col("mode") != "fuzzy", literal),
        F.when(F.col("_folds"), _middle_gram(F.col("_ks"), "s")),
        F.when(F.col("mode") == "fuzzy", _middle_gram(F.col("_kt"), "t")),
    ))
    by_gram = k.select("*", F.explode(grams).alias("gram"), F.substr(literal, F.lit(2), F.lit(GRAM)).alias("_literal"))
    # The forms and lengths that the table's grams have (nine kinds at most); lines are cut into no others.
    kinds = by_gram.select(F.substring("gram", 1, 1).alias("form"), (F.length("gram") - 1).alias("n")).distinct().collect()
    texts = {"c": F.col("_cf"), "s": F.col("_fs"), "t": F.col("_fst")}
    cuts = [_grams(c, form, sorted(r["n"] for r in kinds if r["form"] == form)) for form, c in texts.items() if any(r["form"] == form for r in kinds)]
    in_lines = F.concat(*cuts) if cuts else F.array().cast("array<string>")
    pairs = with_computed(lines, place, _grams=in_lines).select(*place, F.explode("_grams").alias("gram")).join(by_gram, "gram")
    pairs = pairs.select(*[F.col(c).alias(f"_at_{c}") for c in place], "gram", *k.columns, "_literal").distinct()
    both = lines.join(pairs, on=[F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place])
    # A default keyword has grams of two forms; where a line has both, the literal one stands.
    once = ~(F.startswith("gram", F.lit("s")) & F.contains("_cf", "_literal"))
    return both.filter(once & _is_inside()).select(*place, "_snippet", "_kid", _count_inside().alias("inside"), F.lit(False).alias("near"))


def doc_counts(df: DataFrame, keyword: str, mode: str = "default", text_col: str = "text", id_cols=("doc_id",)) -> DataFrame:
    """Whole-text match count per row (rows with zero matches dropped)."""
    ids = _ids(id_cols)
    counted = with_computed(df, ids, count=T.count_matches(text_col, keyword, mode))
    return counted.filter(F.col("count") > 0)


def grep_files(lines: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    """Per-document roll-up of line matches: total, matching lines, and whether pages exist."""
    ids = _ids(id_cols)
    return lines.groupBy(*ids).agg(
        F.sum("count").cast("long").alias("total_matches"),
        F.count(F.lit(1)).cast("long").alias("matching_lines"),
        F.bool_or(F.col("page") > 0).alias("has_pages"),
    )
