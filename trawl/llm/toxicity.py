"""Toxicity by a learned lexicon, misspelled terms included, weighed by the words around each hit.

The lexicon holds words that are far more frequent in toxic training documents than in others.  Its
trie is intersected with Levenshtein automata: the states of the joint automaton are sets of (trie
node, edits so far), found when first needed, so a word is looked up in one step per character
and most words leave the automaton after a few.  Words that clean training documents use are
known words, not misspellings.  A window around each hit tells quotation (quotation marks, a verb of
saying) from abuse; a logistic model weighs the sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, fresh, held_out, ship, train_sample

TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:[*@$!][\p{L}\p{N}]+)*")
WINDOW = 5  # words on each side of a hit
CACHE = 300_000
#: Between letters these are apostrophes.
APOSTROPHE = regex.compile(r"(?<=\p{L})[’‘](?=\p{L})")
QUOTES = "\"“”„«»‘’‹›"
#: Verbs that introduce someone else's words.
SAYING = frozenset("said says say called calls wrote writes quote quoted sagte sagt schrieb nannte zitat dit disait écrit appelé "
                   "cité dijo dice escribió llamó cita".split())
N_FEATURES = 7
STEM_LENGTHS = (4, 5, 6, 7)


def edit_bound(term: str) -> int:
    """Edits (a letter more, less, another, or two neighbours swapped) within which a word is taken for ``term``."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Lexicon:
    """Terms with weights, the trie of the terms, and the joint automaton as far as it was needed.

    ``bound`` gives the edits allowed for a term; the automaton leaves a branch of the trie once it has used up
    what the terms below it allow."""

    MAX_STATES = 200_000

    def __init__(self, terms: dict[str, float], known: frozenset[str] = frozenset(), stems: dict[str, float] | None = None, bound=edit_bound):
        self.terms, self.known, self.stems = terms, known, stems or {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.allowed: list[int] = [0]  # the most edits of the terms below a node
        self.bounds = {t: bound(t) for t in terms}
        for term in sorted(terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], self.bounds[term])
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], self.bounds[term])
            self.ends[node] = term
        self.shortest = min((len(t) - n for t, n in self.bounds.items() if n), default=1 << 30)
        self._start_over()

    def _start_over(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, "", 0)})

    def _state(self, items: set[tuple[int, str, int]]) -> int:
        """Items are (node, letter still to come, edits): the letter is that of two swapped neighbours, of which the later one
        was read first, or empty."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:  # a term's letter left out of the word: down the trie at the cost of one edit
            node, owed, e = todo.pop()
            if e > self.allowed[node] or best.get((node, owed), 9) <= e:
                continue
            best[node, owed] = e
            if not owed:
                todo.extend((child, "", e + 1) for child in self.children[node].values())
        key = frozenset((node, owed, e) for (node, owed), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        to: set[tuple[int, str, int]] = set()
        for node, owed, e in self.sets[state]:
            if owed:
                if owed == c:
                    to.add((node, "", e))
                continue
            if c in self.children[node]:
                to.add((self.children[node][c], "", e))
            if e < self.allowed[node]:
                to.add((node, "", e + 1))  # a letter too many
                for other, child in self.children[node].items():
                    to.add((child, "", e + 1))  # another letter
                    if other != c and c in self.children[child]:
                        to.add((self.children[child][c], other, e + 1))  # two neighbours swapped
        out = self._state(to) if to else -1
        if out >= 0 and not self.sets[out]:
            out = -1
        self.steps[state][c] = out
        return out

    def near(self, word: str) -> str | None:
        """The term nearest to ``word`` within its bound; ties go to the heavier, then the first."""
        if len(self.sets) > self.MAX_STATES:
            self._start_over()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        hits = [(e, -self.terms[t], t) for node, owed, e in self.sets[state] if not owed and (t := self.ends[node]) and e <= self.bounds[t]]
        return min(hits)[2] if hits else None


class Hits(dict):
    """Word to (weight, misspelled) of the term it stands for, or None."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, bool] | None:
        lex = self.lexicon
        found: tuple[float, bool] | None = None
        if word in lex.terms:
            found = (lex.terms[word], False)
        elif word in lex.known:  # clean documents use it, whatever it looks like
            pass
        elif stem := next((word[:n] for n in STEM_LENGTHS if word[:n] in lex.stems), None):
            found = (lex.stems[stem], False)
        elif len(word) >= lex.shortest and (term := lex.near(word)):
            found = (lex.terms[term], True)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Sums over the whole text: abuse, abuse with misspelled terms, quotation, terms met, strongest hit, density."""
        if not text:
            return [0.0] * N_FEATURES
        low = APOSTROPHE.sub("'", text.lower())  # as many characters as before
        words = TOKEN.findall(low)
        at = [i for i, w in enumerate(words) if self[w]]
        if not at:
            return [0.0] * N_FEATURES
        quoted = self._quoted(low, words, at)
        abuse = odd = quote = most = 0.0
        for i, q in zip(at, quoted, strict=True):
            weight, misspelled = self[words[i]]
            if q:
                quote += weight
                continue
            most = max(most, weight)
            if misspelled:
                odd += weight
            else:
                abuse += weight
        kinds = len({words[i] for i, q in zip(at, quoted, strict=True) if not q})
        return [math.log1p(abuse), math.log1p(odd), math.log1p(quote), math.log1p(kinds), most, 100 * (abuse + odd) / (len(words) + 100), float(abuse + odd > 0)]

    def _quoted(self, low: str, words: list[str], at: list[int]) -> list[bool]:
        """For each hit, whether it stands in quoted words: marks on both sides of it in its window, with other words
        between them too, or a verb of saying before it and a mark on either side.  Marks round the one word alone do
        not make it a quotation."""
        spans, wanted = {}, set()
        for i in at:
            wanted.update(range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1)))
        if any(c in low for c in QUOTES):
            for i, m in enumerate(TOKEN.finditer(low)):
                if i in wanted:
                    spans[i] = m.span()
        out = []
        for i in at:
            if not spans:
                out.append(False)
                continue
            a, b = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before = low[max(0, spans[a][0] - 1) : spans[i][0]]
            after = low[spans[i][1] : spans[b][1] + 1]
            left = max((before.rfind(c) for c in QUOTES), default=-1)
            right = min((p for c in QUOTES if (p := after.find(c)) >= 0), default=-1)
            saying = any(w in SAYING for w in words[a:i])
            if left >= 0 and right >= 0:
                more = TOKEN.search(before, left) or TOKEN.search(after, 0, right)
                out.append(bool(more) or saying)
            else:
                out.append(saying and (left >= 0 or right >= 0))
        return out


class Model:
    """A lexicon and the logistic weights of its features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def learn_lexicon(train: DataFrame, max_terms: int, max_known: int, chance_terms: float, least_odds: float) -> Lexicon:
    """``train`` has text and label.  Terms are words whose log odds of document frequency reach ``least_odds`` and whose
    two document counts differ too much for chance: by the Chernoff bound, about ``chance_terms`` of all words tested would
    pass if labels had nothing to do with words.  The ``max_terms`` with the most toxic documents are kept.  Stems are word
    beginnings that pass the same test with clearly more documents than any one word they begin, so that
    they stand for a family of words.  Known are the ``max_known`` words that most clean documents have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+(?:[*@$!][\p{L}\p{N}]+)*"), F.lit(0)))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    share = toxic / max(1, toxic + clean)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))

    def frequencies(strings: Column) -> DataFrame:
        return train.select("label", F.explode(strings).alias("word")).groupBy("word").agg(
            F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")
        ).withColumn("odds", odds)

    def telling(df: DataFrame) -> list:
        n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
        surprise = F.when(t > 0, t * F.log(t / (n * share))).otherwise(0.0) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
        # Words of too few documents to pass even if all are toxic are not tested: one row per number of documents.
        tested, least = 0, math.inf
        for r in sorted(df.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"]):
            if (level := math.log((tested + r["words"]) / chance_terms)) > r["n"] * -math.log(share):
                break
            tested, least = tested + r["words"], level
        found = df.filter((t > 0) & (F.col("odds") >= least_odds) & (surprise >= least))
        return found.orderBy(F.desc("t"), F.desc("odds"), "word").limit(max_terms).select("word", "t", "odds").collect()

    lengths = F.array(*[F.lit(n) for n in STEM_LENGTHS])
    beginnings = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(lengths, lambda n: n < F.length(w)), lambda n: F.substr(w, F.lit(1), n)))))
    df = cut(frequencies(words))
    found, begun = telling(df), telling(cut(frequencies(beginnings)))
    known = df.filter(F.col("c") >= 2).orderBy(F.desc("c"), "word").limit(max_known).select("word").collect()
    most: dict[str, int] = {}
    for r in found:
        for n in STEM_LENGTHS:
            most[r["word"][:n]] = max(most.get(r["word"][:n], 0), r["t"])
    stems: dict[str, float] = {}
    for r in sorted(begun, key=lambda r: (len(r["word"]), r["word"])):
        shorter = any(r["word"][:n] in stems for n in STEM_LENGTHS if n < len(r["word"]))
        if not shorter and r["t"] >= 1.5 * most.get(r["word"], 0):
            stems[r["word"]] = float(r["odds"])
    terms = {r["word"]: float(r["odds"]) for r in found}
    return Lexicon(terms, frozenset(r["word"] for r in known) - set(terms), stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias comes first."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def misspell(word: str, how: int) -> str:
    """``word`` with one letter replaced, dropped, doubled, or swapped with the next, at a place that ``how`` names."""
    at, kind = how // 4 % len(word), how % 4
    if kind == 0:
        return word[:at] + ("x" if word[at] != "x" else "y") + word[at + 1 :]
    if kind == 1:
        return word[:at] + word[at + 1 :]
    if kind == 2:
        return word[: at + 1] + word[at:]
    at = min(at, len(word) - 2)
    return word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]


def misspelled(text: str, hits: Hits, seed: int = 0) -> str:
    """``text`` with every word that is a term, but for the shortest, misspelled; nothing else changes."""
    def swap(m):
        word = m.group().lower()
        how = seed + zlib.crc32(f"{m.start()} {word}".encode("utf-8", "replace"))
        return misspell(word, how) if len(word) >= 4 and hits[word] else m.group()

    return TOKEN.sub(swap, text)


def _features(df: DataFrame, text: str, lexicon: Lexicon, out: str) -> DataFrame:
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by max_terms and max_known

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = Hits(sent.value)
        for texts in batches:
            yield pd.Series([hits.features(t) for t in texts])

    return df.withColumn(out, run.asNondeterministic()(F.col(text).cast("string")))


def _trained(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(label, x) twice for each document: as it is, and with all its terms misspelled, so that the weight of misspelled
    terms comes from such and not from words that look like a term by chance."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = Hits(sent.value)
        for texts in batches:
            yield pd.Series([[hits.features(t), hits.features(misspelled(t, hits))] for t in texts])

    return df.select("label", F.explode(run.asNondeterministic()(F.col("text"))).alias("x"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 16_000, max_terms: int = 1500, max_known: int = 150_000,
        chance_terms: float = 5.0, least_odds: float = 2.5) -> Model:
    """Learns from the toxic labels of about ``max_docs`` documents chosen by a hash of the id: words of one half make
    the lexicon, features of the other half fit the weights, so that no term is weighed by the documents it
    came from.  Rows with null text or a label other than 0 and 1 are not used."""
    sample = cut(train_sample(docs, labels, "toxic", max_docs))
    half = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2))
    lexicon = learn_lexicon(sample.filter(half == 0), max_terms, max_known, chance_terms, least_odds)
    got = _trained(sample.filter(half == 1), lexicon).collect()  # about max_docs rows
    y = np.array([r["label"] for r in got], dtype=float)
    x = np.array([r["x"] for r in got], dtype=float).reshape(-1, N_FEATURES)
    if len(set(y)) < 2:
        return Model(lexicon, np.array([-3.0] + [0.0] * N_FEATURES))
    return Model(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Model, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``out``: the score, 0 to 1, from the whole text alone."""
    w = [float(v) for v in model.weights]
    x = fresh(docs, "_features")
    z = sum((F.col(x)[i] * w[i + 1] for i in range(N_FEATURES)), F.lit(w[0]))
    return _features(docs, text_col, model.lexicon, x).withColumn(out, 1 / (1 + F.exp(-z))).drop(x)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out (never learned from), score (0 to 1, higher: more likely toxic) and
    predicted (1 if the score is 0.5 or more).

    Null and empty texts get the score of a text without hits.  Without labels of both kinds every score
    is that low one.  Repeated rows each get their row; an empty table gives an empty table; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels, **options)
    scored = score(rows, model, "score")
    return scored.select(
        F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns unchanged.

    Null and empty texts stay; repeated rows are judged alike, each by its text; columns of any name are kept as they are; an
    empty table, and one without labels of both kinds, gives back what it got."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels, **options)
    s = fresh(docs, "_score")
    return score(docs, model, s, text_col).filter(F.col(s) < 0.5).drop(s)
