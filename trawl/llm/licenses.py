"""Licence scans: Dice coefficient of word bigrams against templates (DataFrame functions only).

A document is compared as a whole, paragraph by paragraph and line by line.  Dice of two bags of
bigrams can reach a threshold only if their sizes are close, so the number of words of a unit tells
which templates are worth comparing, and units that fit none are dropped before any bigram is made.

Licences that lie otherwise in a document (in several paragraphs or lines, or inside a line) are stretches of
its words.  A template can only be near one if most of its bigrams are in the document, so the longest ones
tell which documents and templates are worth a second look, which tries every stretch from one common bigram
to another whose size is close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut
from trawl.operators.grep import with_computed

#: Templates (fixed values: notices and licence texts as they are used).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
}
#: Template tables with no more bigrams than this are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BIGRAMS = 200_000
#: Pairs of a document and a licence for a second look, as many as are sent to every executor; more are joined by a shuffle.
BROADCAST_WANTED = 200_000
#: Anchors that are looked for by one pattern before a text is cut into bigrams; with more, all texts are cut.
PATTERN_ANCHORS = 5_000
PERCENT = 80
PARAGRAPHS = "\n *\n[ \n]*"


def _bigrams(words: str) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.element_at(F.col(words), i), F.element_at(F.col(words), i + 1)),
    )


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")


def template_bigrams(known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(license_id, bigram, t_count, t_size, anchor, least_anchors) of the templates that have at least two words.
    Anchors are at least half of a template's bigrams, the longest; a text with a stretch that is ``percent`` per cent
    alike has ``least_anchors`` of them."""
    words = with_computed(known.select("license_id", "text"), ["license_id"],
                          _w=F.split(F.trim(F.regexp_replace(_normal(F.col("text")), r"[ \n]+", " ")), " "))
    words = words.filter((F.size("_w") > 1) & F.col("license_id").isNotNull())
    grams = words.select("license_id", (F.size("_w") - 1).alias("t_size"), F.explode(_bigrams("_w")).alias("bigram")).groupBy(
        "license_id", "t_size", "bigram"
    ).agg(F.count(F.lit(1)).alias("t_count"))
    template = Window.partitionBy("license_id", "t_size")
    spare = F.floor(F.col("t_size") * (200 - 2 * percent) / (200 - percent))  # bigrams that may be missing
    before = F.sum("t_count").over(template.orderBy(F.desc(F.length("bigram")), "bigram")) - F.col("t_count")
    grams = grams.withColumn("anchor", before < F.greatest(spare + 1, F.ceil(F.col("t_size") / 2)))
    anchors = F.sum(F.when(F.col("anchor"), F.col("t_count"))).over(template)
    return grams.withColumn("least_anchors", anchors - spare)


def _any_of(anchors: list[str]) -> str:
    """A pattern for any of ``anchors`` between spaces; common beginnings are tried once."""
    tree: dict = {}
    for a in anchors:
        node = tree
        for c in a + " ":
            node = node.setdefault(c, {})

    def pattern(node: dict) -> str:
        run = ""
        while len(node) == 1:
            c, node = next(iter(node.items()))
            run += c
        return run + ("(?:" + "|".join(c + pattern(n) for c, n in sorted(node.items())) + ")" if node else "")

    return " " + pattern(tree)


def _words(norm: Column) -> Column:
    return F.trim(F.regexp_replace(norm, "[ \n]+", " "))


def _with_bigrams(df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """``keep``, ``pos`` and ``bigram`` for each two neighbours of ``words``; the last row, with a null, meets no template."""
    parts = df.withColumn("_w", F.split(words, " ")).select(*keep, "_w", F.posexplode("_w").alias("pos", "_a"))
    return parts.select(*keep, F.col("pos").cast("long").alias("pos"), F.concat("_a", F.lit(" "), F.get("_w", F.col("pos") + 1)).alias("bigram"))


def _normed(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, row, _norm) of ``docs``, or of those that ``only`` has."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                     F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_t"))
    if only is not None:
        df = _same(df, only, "text_hash", how="left_semi")
    return with_computed(df, ["doc_id", "text_hash", "row"], _norm=_normal(F.col("_t")))


def _same(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner", where: Column | None = None) -> DataFrame:
    """Rows of ``a`` joined with ``b`` on the id, null or not, and ``keys``; of ``b``, columns that ``a`` lacks."""
    b = b.select(*[F.col(c).alias(f"_b_{c}" if c in ("doc_id", *keys) else c) for c in b.columns])
    on = F.col("doc_id").eqNullSafe(F.col("_b_doc_id"))
    for k in keys:
        on &= F.col(k) == F.col(f"_b_{k}")
    out = a.join(b, on if where is None else on & where, how)
    return out if how != "inner" else out.drop("_b_doc_id", *[f"_b_{k}" for k in keys])


def _best_stretches(hits: Column, t_size: Column, percent: int) -> Column:
    """Stretches from ``hits``, a template's bigrams in a text by place: (first, last, common, sizes), first and last
    being places of bigrams.  A hit counts in a stretch if ``back``, the same bigram as many times earlier as the
    template has it, lies before the stretch.  Each start has its best end; of stretches that overlap the best stays."""
    most = F.floor((200 - percent) * t_size / percent).cast("int")
    zero = F.lit(0).cast("long")

    def from_start(x: Column, i: Column) -> Column:
        def step(acc: Column, y: Column) -> Column:
            size = y["pos"] - x["pos"] + 1
            common = acc["n"] + F.when(y["back"] >= x["pos"], zero).otherwise(F.lit(1).cast("long"))
            sizes = (size + t_size).cast("long")
            better = (size <= most) & (200 * common >= percent * sizes) & (common * acc["sizes"] > acc["common"] * sizes)
            return F.struct(common.alias("n"), F.when(better, common).otherwise(acc["common"]).alias("common"),
                            F.when(better, sizes).otherwise(acc["sizes"]).alias("sizes"), F.when(better, y["pos"]).otherwise(acc["last"]).alias("last"))

        start = F.struct(zero.alias("n"), zero.alias("common"), F.lit(1).cast("long").alias("sizes"), zero.alias("last"))
        return F.aggregate(F.slice(hits, i + 1, most), start, step, lambda acc: F.struct(
            x["pos"].alias("first"), acc["last"].alias("last"), acc["common"].alias("common"), acc["sizes"].alias("sizes")))

    def keep(acc: Column, x: Column) -> Column:
        old = F.get(acc, F.size(acc) - 1)
        apart = F.coalesce(old["last"] < x["first"], F.lit(True))
        return F.when(apart, F.concat(acc, F.array(x))).when(
            x["common"] * old["sizes"] > old["common"] * x["sizes"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    found = F.filter(F.transform(hits, from_start), lambda x: x["common"] > 0)
    return F.aggregate(found, F.slice(found, 1, 0), keep)


def _stretches(docs: DataFrame, grams: DataFrame, found: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, license_id, unit, place, common, sizes) of the stretches that lie in no unit with the same licence.
    ``found`` has the units that match and the documents with enough anchors."""
    doc = ["doc_id", "text_hash"]
    wanted = found.filter("hopeful").select(*doc, "license_id").distinct()
    n = wanted.count()
    small = F.broadcast if n <= BROADCAST_WANTED else (lambda df: df)
    words = _normed(docs, id_col, text_col, small(wanted.select(*doc).distinct())).select(*doc, _words(F.col("_norm")).alias("words"))
    hits = _same(_with_bigrams(words, "words", doc).join(grams, "bigram"), small(wanted), "text_hash", "license_id")
    key = [*doc, "license_id", "t_size"]
    # A set: rows repeated in the input have the same places.
    places = hits.groupBy(*key, "t_count", "bigram").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    backs = places.select(*key, "t_count", "at", F.posexplode("at").alias("k", "pos")).select(
        *key, F.struct("pos", F.get("at", (F.col("k") - F.col("t_count")).cast("int")).alias("back")).alias("hit"))
    lists = backs.groupBy(*key).agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    best = lists.select(*doc, "license_id", F.inline(_best_stretches(F.col("hits"), F.col("t_size"), percent)))

    inside = _same(found.filter("matched").select(*doc, "license_id", "unit", "place"), wanted, "text_hash", "license_id").distinct()

    def counted(kind: str, cuts: Column) -> Column:
        return F.transform(cuts, lambda x, i: F.struct(F.lit(kind).alias("unit"), (i + 1).cast("long").alias("place"),
                                                       F.size(F.filter(F.split(x, "[ \n]+"), lambda w: w != "")).cast("long").alias("n")))

    cuts = _normed(docs, id_col, text_col, small(inside.select(*doc).distinct())).select(*doc, "row", F.inline(F.concat(
        counted("paragraph", F.split("_norm", PARAGRAPHS)), counted("line", F.split("_norm", "\n")))))
    order = Window.partitionBy(*doc, "row", "unit").orderBy("place")
    spans = cuts.withColumn("end", F.sum("n").over(order))
    spans = _same(spans, inside, "text_hash", "unit", "place").select(
        *doc, "license_id", (F.col("end") - F.col("n")).alias("begin"), "end").distinct()
    # Words first to last + 1, counted from 0, against words begin to end - 1.
    free = _same(best, spans, "text_hash", "license_id", how="left_anti", where=(F.col("first") < F.col("end")) & (F.col("last") + 1 >= F.col("begin")))
    return free.select(*doc, "license_id", F.lit("stretch").alias("unit"), (F.col("first") + 1).alias("place"), "common", "sizes")


def matches(docs: DataFrame, known: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, license_id, unit, place, common, sizes): units whose Dice with a template is at least
    ``percent`` per cent, 2 * common / sizes.  The place of a stretch is that of its first word."""
    grams = cut(template_bigrams(known, percent))
    bounds = grams.agg(F.min("t_size"), F.max("t_size"), F.count(F.lit(1))).first()
    least, most, n = bounds[0] or 0, bounds[1] or 0, bounds[2]
    send = F.broadcast if n <= BROADCAST_BIGRAMS else (lambda df: df)
    low, high = percent * least // (200 - percent), -(-(200 - percent) * most // percent)
    norm = _normed(docs, id_col, text_col)

    def units(kind: str, cuts: Column) -> Column:
        return F.transform(cuts, lambda x, i: F.struct(F.lit(kind).alias("unit"), (i + 1).cast("long").alias("place"), _words(x).alias("words")))

    every = norm.select("doc_id", "text_hash", "row", F.explode(F.concat(
        units("document", F.array("_norm")), units("paragraph", F.split("_norm", PARAGRAPHS)), units("line", F.split("_norm", "\n"))
    )).alias("u")).select("doc_id", "text_hash", "row", "u.*")
    size = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))  # words less one
    whole = F.col("unit") == "document"
    anchors = [r["bigram"] for r in grams.filter("anchor").select("bigram").distinct().limit(PATTERN_ANCHORS + 1).collect()]
    second = whole & F.concat(F.lit(" "), "words", F.lit(" ")).rlike(_any_of(anchors)) if 0 < len(anchors) <= PATTERN_ANCHORS else whole
    fit = every.withColumn("size", size).filter((F.col("size") >= max(1, low)) & ((F.col("size") <= max(1, high)) | second))
    fit = _with_bigrams(fit, "words", ["doc_id", "text_hash", "row", "unit", "place", "size"])
    close = 200 * F.least("size", "t_size") >= percent * (F.col("size") + F.col("t_size"))
    key = ["doc_id", "text_hash", "row", "unit", "place", "size", "license_id", "t_size", "least_anchors"]
    common = fit.join(send(grams), "bigram").filter(close | (whole & F.col("anchor"))).groupBy(*key, "bigram", "anchor").agg(
        F.least(F.count(F.lit(1)), F.max("t_count")).alias("both")
    )
    found = common.groupBy(*key).agg(F.sum("both").alias("common"), F.sum(F.when(F.col("anchor"), F.col("both")).otherwise(0)).alias("anchors"))
    found = found.withColumn("matched", close & (200 * F.col("common") >= percent * (F.col("size") + F.col("t_size"))))
    found = found.withColumn("hopeful", whole & ~F.col("matched") & (F.col("anchors") >= F.col("least_anchors")))
    found = cut(found.filter(F.col("matched") | F.col("hopeful")).withColumn("sizes", (F.col("size") + F.col("t_size")).cast("long")))
    stretches = _stretches(docs, send(grams), found, percent, id_col, text_col)
    return found.filter("matched").select(*stretches.columns).unionByName(stretches)


def scan(docs: DataFrame, known: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, license_id and dice of the best match (null, null if there is none; ties go to
    the licence that sorts first), n_matches (matching units and templates) and license_ids, all matching
    licences in order, comma-joined.  Units are lines, paragraphs, the document, and stretches of words that lie in
    no matching unit of the licence; stretches that overlap count once.

    Null and empty texts match nothing; templates under two words or without an id are left out; repeated rows
    each get their row and one set of matches; an empty table gives an empty table; other columns are not read.
    """
    found = matches(docs, known, percent, id_col, text_col)
    dice = F.round(2 * F.col("common") / F.col("sizes"), 6)
    # distinct: rows repeated in the input have the same matches, which count once.
    per_doc = found.distinct().withColumn("dice", dice).groupBy("doc_id", "text_hash").agg(
        F.min(F.struct((-F.col("dice")).alias("neg"), "license_id")).alias("best"), F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("license_ids"),
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("best.license_id").alias("license_id"),
             (-F.col("best.neg")).alias("dice"), "n_matches", "license_ids")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    out = base.join(per_doc, on=[base.doc_id.eqNullSafe(per_doc["_id"]), base.text_hash == per_doc["_hash"]], how="left")
    return out.select(F.col("doc_id").alias(id_col), "license_id", "dice", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
                      F.coalesce("license_ids", F.lit("")).alias("license_ids"))
