"""Benchmark decontamination by a prefix-filtered join (DataFrame functions only).

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window).  A window occurs in a document only if all its words do, so one word of it is a sufficient
join key: the necessary prefix of a set whose containment must be whole is its first token in order
of rarity.  Words are ordered by their count over all documents, each window is looked up by its
rarest word, the place of that word in the window gives the only possible start (positional bound),
the window must end inside the document (length bound), and the words of that stretch are then
compared with the window itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import ascii_lower, cut, fresh
from trawl.operators.grep import with_computed

#: What lies between words: ASCII without letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmark tables whose words take no more bytes than this are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def pieces(text: Column) -> Column:
    """The words as they are written, with an empty piece before a leading gap and one after a trailing gap."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), GAP)


def word_count(text: Column) -> Column:
    p = pieces(text)
    empty = (F.element_at(p, 1) == "").cast("int") + (F.element_at(p, -1) == "").cast("int")
    return F.greatest(F.size(p) - empty, F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(pieces(ascii_lower(text.cast("string"))), lambda w: w != "")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, words) windows of the items; items without words or without an id have none."""
    w = with_computed(items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("_t")), ["item_id"], _w=words(F.col("_t")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)))
    return (
        w.filter(F.col("item_id").isNotNull() & (F.size("_w") > 0))
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i + 1, window))).alias("window_words"))
        .distinct()
    )


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(occurrences, windows): distinct (doc_id, text_hash, start, window_id), ``start`` 0-based in words,
    and (window_id, n_window, item_id)."""
    windows = cut(item_windows(items, window, item_id_col, item_text_col))
    distinct = windows.select("window_words").distinct().withColumn("window_id", F.concat_ws(" ", "window_words"))
    size = distinct.agg(F.sum(F.octet_length("window_id") + 16 * F.size("window_words"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    send = F.broadcast if small else (lambda df: df)

    # Documents are cut but not rewritten: keys are compared in full lower case, which texts that are equal
    # after A-Z to a-z share, and only the stretch a key points at is lower-cased by that rule.
    tokens = distinct.select("window_id", F.posexplode(F.transform("window_words", F.lower)).alias("offset", "word"))
    doc_words = with_computed(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t")),
        ["doc_id", "_t"], _w=pieces(F.col("_t")),
    )
    counts = cut(
        doc_words.select(F.explode("_w").alias("word")).select(F.lower("word").alias("word"))
        .join(send(tokens.select("word").distinct()), "word", "left_semi")
        .groupBy("word").count()
    )
    # A word that no document has rules its windows out; else the rarest word is the key.
    ranked = tokens.join(send(counts), "word", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("key")
    )
    keys = cut(
        ranked.filter(F.col("key.n") > 0)
        .select("window_id", F.col("key.word").alias("word"), F.col("key.offset").alias("offset"))
        .join(distinct.select("window_id", F.size("window_words").alias("n_window")), "window_id")
    )
    start = F.col("pos") - F.col("offset")
    stretch = ascii_lower(F.array_join(F.slice(F.col("_w"), F.col("start") + 1, F.col("n_window")), " "))
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("n_window") <= F.col("n_words"))
    hashed = doc_words.select("doc_id", F.xxhash64("_t").alias("text_hash"), "_w", F.size("_w").alias("n_words"))
    if small:  # a document's words stay beside their places: the join is within the task
        places = hashed.select("*", F.posexplode("_w").alias("pos", "piece")).withColumn("word", F.lower("piece"))
        found = places.join(F.broadcast(keys), "word").withColumn("start", start).filter(inside)
    else:  # places travel without the words, and what they point at is fetched once per document
        places = hashed.select("doc_id", "text_hash", "n_words", F.posexplode("_w").alias("pos", "piece"))
        near = places.select("*", F.lower("piece").alias("word")).join(keys, "word").withColumn("start", start).filter(inside)
        per_doc = near.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
            F.collect_set(F.struct("start", "window_id", "n_window")).alias("_near"))
        same = [hashed["doc_id"].eqNullSafe(per_doc["_id"]), hashed["text_hash"] == per_doc["_hash"]]
        found = hashed.join(per_doc, on=same).select("doc_id", "text_hash", "_w", F.inline("_near"))
    hits = found.filter(stretch == F.col("window_id")).select("doc_id", "text_hash", "start", "window_id").distinct()
    return hits, windows.select(
        F.concat_ws(" ", "window_words").alias("window_id"), F.size("window_words").alias("n_window"), "item_id"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, min_share: tuple[int, int] = (1, 20),
                  id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_words, n_hit (words inside an occurring window),
    n_items and item_ids (items with an occurring window, sorted as strings) and contaminated: any
    hit and at least ``min_share`` of the words hit.

    Nulls and empty texts have no words and are never contaminated; a null id is a value of its own;
    items with null id or without words match nothing.  Repeated rows each get their row.  An empty
    benchmark leaves every document clean.  Other columns are not read.
    """
    found, windows = occurrences(docs, items, window, id_col, text_col, item_id_col, item_text_col)
    hits = cut(found.join(windows.select("window_id", "n_window").distinct(), "window_id"))
    spans = hits.select("doc_id", "text_hash", "start", (F.col("start") + F.col("n_window")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("_seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = covered.groupBy("doc_id", "text_hash").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_seen"))).alias("n_hit")
    )
    items_of = (
        hits.select("doc_id", "text_hash", "window_id").join(windows.select("window_id", "item_id"), "window_id")
        .select("doc_id", "text_hash", "item_id").distinct()
        .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    )
    per_doc = n_hit.join(items_of, on=[n_hit.doc_id.eqNullSafe(items_of.doc_id), n_hit.text_hash == items_of.text_hash]).select(
        n_hit.doc_id.alias("_hit_id"), n_hit.text_hash.alias("_hit_hash"), "n_hit", "item_ids"
    )
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("text_hash"), word_count(F.col("_t")).alias("n_words")
    )
    more, least = min_share[1], min_share[0]
    out = base.join(per_doc, on=[base.doc_id.eqNullSafe(F.col("_hit_id")), base.text_hash == F.col("_hit_hash")], how="left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").alias(id_col), "text_hash", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), ((n > 0) & (n * more >= F.col("n_words") * least)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns unchanged.

    Null and empty texts have no words and stay; a row goes by its own text, so of rows with one id, null or not, only those
    with a contaminated text go, all copies alike; no items, or items without words, leave every row; columns of any
    name are kept as they are; an empty table gives an empty one."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    h, b = fresh(docs, "_text_hash"), bad.select(F.col(id_col).alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    left = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    return left.join(b, on=[left[id_col].eqNullSafe(b["_bad_id"]), left[h] == b["_bad_hash"]], how="left_anti").drop(h)
