"""Language identification by words first, character n-grams for words not seen in training.

Each word adds its log relative frequency in every language.  A word that no language has is cut
into n-grams of the longest trained length, with a mark at both ends; if none of them is known, into
shorter ones, down to single characters.  The mean over the words decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut, fresh, held_out, ship

LONGEST = 5
CACHE_CELLS = 8_000_000  # scores a worker remembers (words times languages); the table starts anew when full
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Model:
    """Log relative frequencies of words (size 0) and n-grams (their length), kept for the languages that have them.

    ``blank`` has a row per size: the value of a language without the key, by additive smoothing.  A key's
    row lists the languages that have it and how far they are above ``blank``."""

    def __init__(self, langs: list[str], keys: list[dict[str, int]], starts: np.ndarray, lang_of: np.ndarray, above: np.ndarray, blank: np.ndarray):
        self.langs, self.keys, self.starts, self.lang_of, self.above, self.blank = langs, keys, starts, lang_of, above, blank

    def mean(self, rows: list[int], size: int) -> np.ndarray:
        """The mean vector of some keys of one size."""
        at = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in rows]) if len(rows) > 1 else slice(self.starts[rows[0]], self.starts[rows[0] + 1])
        sums = np.bincount(self.lang_of[at], weights=self.above[at], minlength=len(self.langs))
        return self.blank[size] + sums / len(rows)

    def vector(self, word: str) -> np.ndarray | None:
        """A known word's own values; else the mean of its longest known n-grams."""
        known = self.keys[0].get(word)
        if known is not None:
            return self.mean([known], 0)
        marked = f" {word} "
        for n in range(LONGEST, 0, -1):
            get = self.keys[n].get
            found = [r for i in range(len(marked) - n + 1) if (r := get(marked[i : i + n])) is not None]
            if found:
                return self.mean(found, n)
        return None


class Scores(dict):
    """Word to row of a growing score matrix; row 0 is for words that tell nothing."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.most = max(1024, CACHE_CELLS // len(model.langs))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows = np.zeros((1024, len(self.model.langs)), dtype=np.float32)
        self.n = 1

    def __missing__(self, word: str) -> int:
        vector = self.model.vector(word)
        if vector is None:
            self[word] = 0
            return 0
        if self.n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.n] = vector
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def judge(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return UNKNOWN, 0.0
        if len(self) > self.most:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        known = np.count_nonzero(at)
        mean = self.rows[at].sum(axis=0, dtype=np.float64) / max(1, known)
        share = np.exp(mean - mean.max())
        best = int(np.argmax(mean))
        return self.model.langs[best], float(share[best] / share.sum())


def fit(train: DataFrame, docs_per_lang: int = 2000, max_words: int = 80_000, max_grams: int = 60_000, least_keys: int = 500,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns every language that occurs, from about ``docs_per_lang`` of its rows, chosen by a hash of the id.

    Every language has the same room: its most frequent words, ``max_words`` divided by the number of languages but at
    least ``least_keys``, and likewise ``max_grams`` for the n-grams of each length.  A key that has a place in one
    language is kept for all that have it.  Rows with null text or language are not used."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([UNKNOWN], [{} for _ in range(LONGEST + 1)], np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((LONGEST + 1, 1)))
    steps = 1 << 30
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(steps * min(1.0, docs_per_lang / r["count"]))))])
    sample = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(steps)) < share[F.col("lang")])
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    words = cut(sample.select("lang", F.explode(letters).alias("key")).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")))
    marked = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    # All lengths at once; a word is short, so its grams are few.
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.length(marked)), lambda i: i + n - 1 <= F.length(marked)), lambda i: F.substr(marked, i, n))))
    cut_up = words.select("lang", "n", F.explode(grams).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = cut(words.select("lang", F.lit(0).alias("size"), "key", "n").union(cut_up.select("lang", F.length("key").alias("size"), "key", "n")))
    totals = {(r["size"], r["lang"]): float(r["n"]) for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    room = F.when(F.col("size") == 0, max(least_keys, max_words // len(langs))).otherwise(max(least_keys, max_grams // len(langs)))
    place = F.row_number().over(Window.partitionBy("size", "lang").orderBy(F.desc("n"), "key"))
    most = max(least_keys, max(max_words, max_grams) // len(langs))
    kept = counts.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") <= room).select("size", "key").distinct()
    got = counts.join(kept, ["size", "key"]).toPandas().sort_values(["size", "key", "lang"])  # bounded by the room of all languages
    lang_of = got["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=np.int64)
    size, key = got["size"].to_numpy(), got["key"].to_numpy()
    # Half an occurrence more for every key that was kept, so that a language with few documents is not favoured where it has none.
    kinds = [len(set(key[size == n])) for n in range(LONGEST + 1)]
    blank = np.array([[math.log(0.5 / (totals.get((n, lang), 0.0) + 0.5 * max(1, kinds[n]))) for lang in langs] for n in range(LONGEST + 1)])
    above = np.log(2 * got["n"].to_numpy(dtype=float) + 1)
    opens = np.ones(len(got), dtype=bool)
    opens[1:] = (size[1:] != size[:-1]) | (key[1:] != key[:-1])
    starts = np.append(np.flatnonzero(opens), len(got))
    keys: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    for row, i in enumerate(starts[:-1]):
        keys[size[i]][key[i]] = row
    return Model(langs, keys, starts, lang_of, above, blank)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out (not usable for training), lang_pred and score, the winner's share
    (0 to 1).  Only the text is read for a prediction.

    A null text, an empty one and one without letters give ``und`` and 0.  Ties go to the language that
    sorts first.  An empty table gives an empty table; other columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the room that fit gives to each language

    @F.pandas_udf("struct<lang:string, score:double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = Scores(sent.value)
        for texts in batches:
            yield pd.DataFrame([scores.judge(t) for t in texts], columns=["lang", "score"])

    r = fresh(docs, "_judged")
    judged = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), judge.asNondeterministic()(F.col(text_col).cast("string")).alias(r))
    return judged.select(id_col, "held_out", F.col(r)["lang"].alias("lang_pred"), F.col(r)["score"].alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``fit`` on the rows that are not held out, then ``predict`` for all."""
    model = fit(docs.filter(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, model, id_col, text_col)
