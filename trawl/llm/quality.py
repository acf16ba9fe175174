"""Quality rules: lines marked as content or boilerplate by a linear-chain conditional random field.

Base rules look at the words of the whole text.  Documents that pass them have their lines turned into
binary features and labelled by Viterbi decoding; the share of words in content lines decides.  The field
is trained on documents of known quality whose lines all carry their document's label.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import fresh, ship, train_sample

WINDOW = 8
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "always", "few words", "many words", "shouted", "some symbols", "many symbols", "bars", "exclaimed", "digits", "ends like a sentence",
    "seen before", "few different words", "word runs", "starts upper case", "address or code",
)
PIECE = 64  # a longer training sequence is cut into several of so many lines, all of which are used


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mix = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.sort(mix)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    maybe = np.flatnonzero(np.isin(mix, twice))  # equal hashes: compare the words themselves
    seen = Counter(tuple(words[i : i + window]) for i in maybe)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.array([i for i in maybe if seen[tuple(words[i : i + window])] > 1], dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def line_features(line: str, seen: set[str]) -> int:
    """The features of a line with words as bits; ``seen`` holds the lines before it."""
    words = line.split()
    n, chars = len(words), len(line)
    symbols = sum(line.count(c) for c in SYMBOLS)
    upper, lower = sum(map(str.isupper, words)), sum(map(str.islower, words))
    first = next((c for c in line if c.isalpha()), "")
    flags = (
        True, n <= 3, n >= 8, upper > 0.5 * n and n > 1, symbols > 0.01 * chars, symbols > 0.05 * chars,
        line.count("|") >= 3, line.count("!!") >= 2, sum(map(line.count, "0123456789")) > 0.2 * chars, line.rstrip()[-1:] in ".!?…:;\"'”»)",
        line in seen, n >= 6 and len(set(words)) < 0.5 * n,
        any(words[i] == words[i + 1] == words[i + 2] for i in range(n - 2)) if n >= 3 and len(set(words)) < n else False,
        first.isupper() and upper < n, "http" in line or "{" in line or "www." in line,
    )
    seen.add(line)
    return sum(1 << i for i, f in enumerate(flags) if f)


def lines_of(text: str | None) -> list[tuple[int, int]]:
    """(features, words) of the lines that have words."""
    seen: set[str] = set()
    return [(line_features(x, seen), len(x.split())) for x in (text or "").split("\n") if x.split()]


class Field:
    """A linear-chain field with two labels, 0 boilerplate and 1 content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (features, 2) and (2, 2)
        self._scores: dict[int, tuple[float, float]] = {}

    def scores(self, bits: int) -> tuple[float, float]:
        s = self._scores.get(bits)
        if s is None:
            on = [i for i in range(len(FEATURES)) if bits >> i & 1]
            s = self._scores[bits] = tuple(self.emit[on].sum(axis=0))
        return s

    def viterbi(self, bits: list[int]) -> list[int]:
        """The best labels; ties go to content."""
        if not bits:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.scores(bits[0])
        back = []
        for x in bits[1:]:
            ea, eb = self.scores(x)
            from_a, from_b = b + m10 < a + m00, b + m11 < a + m01
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + m00 if from_a else b + m10) + ea, (a + m01 if from_b else b + m11) + eb
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def content_share(self, text: str | None) -> float:
        lines = lines_of(text)
        total = sum(n for _, n in lines)
        if not total:
            return 0.0
        return sum(n for (_, n), y in zip(lines, self.viterbi([b for b, _ in lines]), strict=True) if y) / total


def train_field(sequences: list[tuple[list[int], int]], steps: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam) over padded sequences of line features with one label each.  A sequence
    of more than ``PIECE`` lines is cut into pieces that together weigh as much as any other.  With fewer than
    two labels everything is content."""
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    sequences = [(b, y) for b, y in sequences if b]
    docs = len(sequences)
    if len({y for _, y in sequences}) < 2:
        emit[0, 1] = 1.0
        return Field(emit, move)
    share = np.bincount([y for _, y in sequences], minlength=2) / docs
    whole = np.array([len(b) for b, _ in sequences for _ in range(0, len(b), PIECE)])
    sequences = [(b[i : i + PIECE], y) for b, y in sequences for i in range(0, len(b), PIECE)]
    n, t = len(sequences), max(len(b) for b, _ in sequences)
    bits = np.zeros((n, t), dtype=np.int64)
    for i, (b, _) in enumerate(sequences):
        bits[i, : len(b)] = b
    x = (bits[:, :, None] >> np.arange(len(FEATURES)) & 1).astype(float)  # all zero where padded
    mask = np.arange(t) < np.array([len(b) for b, _ in sequences])[:, None]
    y = np.array([label for _, label in sequences])
    weight = (0.5 / share)[y] / whole  # classes alike, documents alike
    gold_x = np.einsum("nt,ntf,nl->fl", mask * weight[:, None], x, np.eye(2)[y])
    gold_m = np.diag(np.bincount(y, weights=weight * (mask.sum(axis=1) - 1), minlength=2))
    m1, m2 = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for k in range(1, steps + 1):
        e, tr = x @ emit, np.exp(move)
        ex = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.zeros((n, t, 2)), np.ones((n, t, 2))
        alpha[:, 0] = ex[:, 0] / ex[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ tr) * ex[:, i]
            alpha[:, i] = np.where(mask[:, i, None], a / a.sum(axis=1, keepdims=True), alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            b = (ex[:, i + 1] * beta[:, i + 1]) @ tr.T
            beta[:, i] = np.where(mask[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        p = alpha * beta
        p = p / p.sum(axis=2, keepdims=True) * (mask * weight[:, None])[:, :, None]
        q = alpha[:, :-1, :, None] * tr[None, None] * (ex[:, 1:] * beta[:, 1:])[:, :, None, :]
        q = q / q.sum(axis=(2, 3), keepdims=True) * (mask[:, 1:] * weight[:, None])[:, :, None, None]
        grads = [(gold_x - np.einsum("ntf,ntl->fl", x, p)) / docs - ridge * emit, (gold_m - q.sum(axis=(0, 1))) / docs - ridge * move]
        for j, w in enumerate((emit, move)):
            m1[j] = 0.9 * m1[j] + 0.1 * grads[j]
            m2[j] = 0.99 * m2[j] + 0.01 * grads[j] ** 2
            w += rate * (m1[j] / (1 - 0.9**k)) / (np.sqrt(m2[j] / (1 - 0.99**k)) + 1e-8)
    return Field(emit, move)


def _line_bits(texts: pd.Series) -> pd.Series:
    return pd.Series([[b for b, _ in lines_of(t)] for t in texts])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000) -> Field:
    """Learns from the quality labels of about ``max_docs`` documents chosen by a hash of the id, from all of their
    lines; rows with null text or another label than 0 and 1 are not used."""
    ship(docs.sparkSession)
    sample = train_sample(docs, labels, "quality", max_docs, salt=9)
    got = sample.select("label", F.pandas_udf(_line_bits, "array<int>").asNondeterministic()("text").alias("b")).collect()  # about max_docs lists, a number per line
    return train_field(sorted((list(r["b"]), r["label"]) for r in got))


COUNTS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,content_share:double,kept:boolean>"


def _judged(docs: DataFrame, field: Field, min_share: float, out: str, text_col: str) -> DataFrame:
    @F.pandas_udf(COUNTS)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            counts = base_counts(t)
            bad = failed(counts[0], counts[4])
            share = field.content_share(t)
            rows.append((*counts, bad, share, not bad and share >= min_share))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return docs.withColumn(out, judge.asNondeterministic()(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under
    20 words, or over 30 % of them in repeated 8-word windows), content_share and kept: not base_failed and
    at least ``min_share`` of the words in lines that the field marks as content.

    A null text has no words and fails.  Whole texts are read.  Without labels of both kinds every line is
    content.  Repeated rows each get their row; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = fit(rows, labels, **options)
    return _judged(rows, field, min_share, "_q", "text").select(F.col("doc_id").alias(id_col), "_q.*")


def keep_good(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, columns unchanged.

    Null and empty texts fail the base rules and go; repeated rows are judged alike, each by its text; without labels of
    both kinds the base rules alone decide; columns of any name are kept as they are; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = fit(rows, labels, **options)
    q = fresh(docs, "_q")
    return _judged(docs, field, min_share, q, text_col).filter(F.col(q)["kept"]).drop(q)
