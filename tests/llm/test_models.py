import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import langid, quality, toxicity
from trawl.llm.common import held_out


def test_held_out_is_the_checksum_rule(spark):
    got = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# --- language ---

def test_language_on_held_out_documents(small):
    docs = small("documents", "0.01")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_reads_only_the_text(docs_of, odd_pairs, small):
    model = langid.fit(small("documents", "0.01").filter(~held_out(F.col("doc_id"))))
    a = langid.predict(docs_of(odd_pairs), model).collect()
    b = langid.predict(docs_of([(9000, t) for _, t in odd_pairs], lang="zz"), model).collect()
    assert sorted((r["lang_pred"], r["score"]) for r in a) == sorted((r["lang_pred"], r["score"]) for r in b)
    und = {r["doc_id"] for r in a if r["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and not und & {4, 7, 8, 9}
    assert len(a) == len(odd_pairs)
    assert langid.predict(docs_of([]), model).count() == 0


def tiny_model():
    keys = [{"word": 0}, {"b": 2, " ": 3}, {"ab": 1}, {}, {}, {}]
    values = np.array([(-3, -1), (-1, -5), (-4, -2), (-9, -9)], dtype=float)
    return langid.Model(["x", "y"], keys, np.arange(0, 9, 2), np.array([0, 1] * 4), values.ravel() + 10, np.full((6, 2), -10.0))


def test_backoff_goes_from_words_to_shorter_grams():
    scores = langid.Scores(tiny_model())
    assert scores.judge("word")[0] == "y"
    assert scores.judge("zabz")[0] == "x"  # the bigram is known, shorter grams are not asked
    assert scores.judge("zbz")[0] == "y"
    assert scores.judge("12 !?") == ("und", 0.0) and scores.judge(None) == ("und", 0.0)
    scores.most = 1  # the table starts anew between texts
    assert scores.judge("word zbz") == scores.judge("zbz word") and len(scores) <= 2


def brute_language(model, text):
    """Word by word from the model's lists, one language at a time."""
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|\p{M})*".replace("\\p{M}", "[\u0300-\u036f]"), (text or "").lower())
    if not words:
        return "und", 0.0
    def value(size, key, lang):
        row = model.keys[size].get(key)
        own = {model.langs[k]: v for k, v in zip(model.lang_of[model.starts[row]:model.starts[row + 1]], model.above[model.starts[row]:model.starts[row + 1]])}
        return model.blank[size, model.langs.index(lang)] + own.get(lang, 0.0)
    sums, known = dict.fromkeys(model.langs, 0.0), 0
    for w in words:
        marked = f" {w} "
        for size, found in [(0, [w] if w in model.keys[0] else [])] + [
                (n, [g for i in range(len(marked) - n + 1) if (g := marked[i:i + n]) in model.keys[n]]) for n in range(5, 0, -1)]:
            if found:
                known += 1
                for lang in model.langs:
                    sums[lang] += sum(value(size, g, lang) for g in found) / len(found)
                break
    means = {lang: v / max(1, known) for lang, v in sums.items()}
    best = max(model.langs, key=lambda x: means[x])
    return best, 1 / sum(math.exp(v - means[best]) for v in means.values())


def test_predictions_equal_brute_force(small, docs_of, odd_pairs):
    docs = small("documents", "0.01")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))), docs_per_lang=60, max_words=800, max_grams=800, least_keys=50)
    sample = docs.filter("doc_id % 7 = 0").select("doc_id", "text")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(sample, model).collect()}
    for r in sample.collect():
        lang, score = brute_language(model, r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-3


def test_every_language_has_its_room(spark):
    """A language with few documents beside a large one, and more languages than any list of frequent ones."""
    rnd = random.Random(2)
    def word(letters):
        return "".join(rnd.choices(letters, k=5))
    rows = [(i, " ".join(word("abcde") for _ in range(60)), "large") for i in range(300)]
    rows += [(1000 + i, " ".join(word("vwxyz") for _ in range(10)), "small") for i in range(3)]
    rows += [(2000 + i, " ".join(["tongue" + chr(97 + i // 26) + chr(97 + i % 26)] * 5), f"l{i:03d}") for i in range(450)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, docs_per_lang=100, max_words=2000, max_grams=1000, least_keys=10)
    assert len(model.langs) == 452
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(train, model).collect()}
    assert all(got[1000 + i] == "small" for i in range(3)) and all(got[2000 + i] == f"l{i:03d}" for i in range(0, 450, 10))


def test_language_learns_nothing_from_an_empty_table(docs_of):
    model = langid.fit(docs_of([]))
    assert langid.predict(docs_of([(1, "some text"), (2, None)]), model).count() == 2


# --- toxicity ---

def edits(a, b):
    """Letters more, less, other, or two neighbours swapped."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("bound", [lambda t: 0, lambda t: 1 if len(t) >= 4 else 0, lambda t: 2, toxicity.edit_bound])
def test_automaton_finds_what_edit_distance_finds(bound):
    rnd = random.Random(bound("abcdefgh"))
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(400)]
    terms = {w: float(i) for i, w in enumerate(sorted(set(words[:30])))}
    lex = toxicity.Lexicon(terms, bound=bound)
    for w in words:
        near = [(d, -terms[t], t) for t in terms if (d := edits(w, t)) <= bound(t)]
        assert lex.near(w) == (min(near)[2] if near else None), w


def test_misspelled_quoted_and_known_words():
    hits = toxicity.Hits(toxicity.Lexicon({"idiot": 4.0, "scum": 3.0, "ass": 2.0, "worthless": 5.0}, frozenset({"idiom", "blarney"}), {"blar": 2.0}))
    assert hits["idiot"] == (4.0, False) and hits["idjot"] == (4.0, True) and hits["id1iot"] == (4.0, True)
    assert hits["idoit"] == (4.0, True) and hits["wrthlss"] == (5.0, True) and hits["scumm"] == hits["sucm"] == (3.0, True)
    assert hits["idiom"] is None and hits["blarney"] is None and hits["asx"] is None  # known words; too short a term for edits
    assert hits["blarfoo"] == (2.0, False) and hits["bla"] is None
    abuse, odd, quote, _, most, _, any_hit = hits.features("you are an idoit today")
    assert abuse == quote == 0 and odd > 0 and most == 4.0 and any_hit == 1.0
    abuse, _, quote, *_ = hits.features('they said "what an idiot" to us')
    assert abuse == 0 and quote > 0
    for text in ("I don’t like that idiot, it’s bad", "don't like that idiot, it's bad", 'you "idiot" there', "you «idiot» there"):
        abuse, _, quote, *_ = hits.features(text)
        assert abuse > 0 and quote == 0, text
    assert hits.features('he called me an "idiot" there')[2] > 0  # a verb of saying before the one word
    far = "far away words go here before any of the marks "
    assert hits.features('"quoted" ' + far + "idiot " + far)[0] > 0
    assert hits.features(None) == hits.features("") == [0.0] * toxicity.N_FEATURES


def test_misspelling_changes_terms_only():
    hits = toxicity.Hits(toxicity.Lexicon({"idiot": 4.0, "ass": 1.0}))
    text = "You Idiot, you ass; other words stay."
    for seed in range(40):
        got = toxicity.misspelled(text, hits, seed)
        assert got.startswith("You ") and got.endswith(", you ass; other words stay.") and edits(got[4:].split(",")[0].lower(), "idiot") <= 1
    assert {toxicity.misspell("abcd", k) for k in range(16)} >= {"xbcd", "bcd", "aabcd", "bacd", "abdc", "abcdd"}


def test_scores_equal_brute_force(small):
    """From a fitted model: each word by the edit distances to all terms, the sums and the logistic by hand."""
    docs, labels = small("documents", "0.01").select("doc_id", "text"), small("labels", "0.01")
    model = toxicity.fit(docs, labels)
    lex, hits = model.lexicon, toxicity.Hits(model.lexicon)
    sample = [tuple(r) for r in docs.filter("doc_id % 5 = 1").collect()]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, "score").collect()}
    lookup = {}
    def stands_for(w):
        if w in lex.terms:
            return lex.terms[w], False
        if w in lex.known:
            return None
        stems = [w[:n] for n in toxicity.STEM_LENGTHS if w[:n] in lex.stems]
        if stems:
            return lex.stems[stems[0]], False
        near = [(d, -lex.terms[t], t) for t in lex.terms if abs(len(t) - len(w)) <= toxicity.edit_bound(t) and (d := edits(w, t)) <= toxicity.edit_bound(t)]
        return (lex.terms[min(near)[2]], True) if near else None
    for doc, text in sample:
        words = toxicity.TOKEN.findall(toxicity.APOSTROPHE.sub("'", (text or "").lower()))
        at = []
        for i, w in enumerate(words):
            if w not in lookup:
                lookup[w] = stands_for(w)
            if lookup[w]:
                at.append(i)
        quoted = hits._quoted(toxicity.APOSTROPHE.sub("'", (text or "").lower()), words, at) if at else []
        plain = [lookup[words[i]] for i, q in zip(at, quoted) if not q]
        abuse, odd = (sum(w for w, m in plain if m == k) for k in (False, True))
        x = [math.log1p(abuse), math.log1p(odd), math.log1p(sum(lookup[words[i]][0] for i, q in zip(at, quoted) if q)),
             math.log1p(len({words[i] for i, q in zip(at, quoted) if not q})), max([w for w, _ in plain], default=0.0),
             100 * (abuse + odd) / (len(words) + 100), float(abuse + odd > 0)]
        if not at:
            x = [0.0] * 7
        assert abs(got[doc] - 1 / (1 + math.exp(-(model.weights[0] + np.dot(model.weights[1:], x))))) < 1e-9


def test_misspelled_abuse_of_held_out_documents(small):
    """Every term of the toxic documents that are caught is misspelled in one way; clean documents are left alone."""
    docs, labels = small("documents", "0.1").select("doc_id", "text"), small("labels", "0.1")
    model = toxicity.fit(docs, labels)
    hits = toxicity.Hits(model.lexicon)
    def marked(text):
        return model.weights[0] + np.dot(model.weights[1:], hits.features(text)) >= 0
    rows = docs.join(labels, "doc_id").filter(held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("text").isNotNull()).select("text", "toxic").collect()
    caught = [r["text"] for r in rows if r["toxic"] == 1 and marked(r["text"])]
    clean = [r["text"] for r in rows if r["toxic"] == 0]
    assert len(caught) > 80 and sum(map(marked, clean)) <= 0.01 * len(clean)
    for kind in range(4):
        def swap(m, kind=kind):
            w = m.group().lower()
            how = 4 * zlib.crc32(f"{w}{m.start()}".encode()) + kind
            return toxicity.misspell(w, how) if len(w) >= 4 and hits[w] else m.group()
        assert sum(marked(toxicity.TOKEN.sub(swap, t)) for t in caught) >= 0.88 * len(caught), kind


def test_lexicon_has_words_of_few_but_telling_documents(spark):
    rnd = random.Random(3)
    noise = ["w" + "".join(rnd.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = [(" ".join(rnd.sample(noise, 5)) + (" blargon" if i < 1200 else ""), 1) for i in range(1200)]
    texts += [(" ".join(rnd.sample(noise, 5)) + " zuvanek mirtolo", 1) for _ in range(15)]  # another language, 1.2 %
    texts += [(" ".join(rnd.sample(noise, 5)), 0) for _ in range(4000)]
    lex = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, label int"), 1500, 1000, 1.0, 2.5)
    assert set(lex.terms) == {"blargon", "zuvanek", "mirtolo"}


def test_toxicity_on_held_out_documents(small):
    docs, labels = small("documents", "0.1"), small("labels", "0.1")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    table = Counter((r["toxic"], r["predicted"]) for r in got)
    assert table[1, 1] > 0.85 * (table[1, 1] + table[1, 0])
    assert table[0, 1] < 0.01 * table[0, 0]


def test_toxicity_of_odd_rows(spark, docs_of, odd_pairs):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs_of(odd_pairs), labels).collect()
    assert len(got) == len(odd_pairs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(docs_of(odd_pairs), labels.limit(0)).count() == len(odd_pairs)
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    kept = toxicity.drop_toxic(docs_of(odd_pairs), labels)
    assert kept.columns == docs_of([]).columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs, labels = small("documents", "0.01"), small("labels", "0.01")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).select("doc_id", "score").collect() for x in (labels, turned))
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


# --- quality ---

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_base_counts(small, odd_pairs):
    rnd = random.Random(8)
    texts = [t for _, t in odd_pairs] + [r["text"] for r in small("documents", "0.01").collect()]
    texts += ["".join(rnd.choices("ab \n\x0b\x1c\x85#|", k=rnd.randint(0, 300))) for _ in range(300)] + ["x " * 500, "a b c " * 40]
    for t in texts:
        assert quality.base_counts(t) == brute_base(t)


def test_viterbi_finds_the_best_labels():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        field = quality.Field(rnd.normal(size=(len(quality.FEATURES), 2)), rnd.normal(size=(2, 2)))
        bits = [int(b) for b in rnd.integers(1, 1 << len(quality.FEATURES), size=7)]
        def total(labels):
            s = sum(field.scores(b)[y] for b, y in zip(bits, labels))
            return s + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))
        best = max(map(total, product((0, 1), repeat=7)))
        assert abs(total(field.viterbi(bits)) - best) < 1e-9


def test_field_learns_line_labels():
    good, bad = quality.line_features("A sentence of many ordinary words, as it should be.", set()), quality.line_features("HOME!! | MENU!! | ABOUT!! | LOGIN!!", set())
    field = quality.train_field([([good] * 5, 1)] * 20 + [([bad] * 4, 0)] * 20)
    assert field.viterbi([good, good, bad, bad, bad, good, good]) == [1, 1, 0, 0, 0, 1, 1]


def test_field_learns_from_late_lines_too():
    """Lines that differ only after the first piece of a long sequence."""
    same, late = quality.line_features("Some ordinary words of a line.", set()), quality.line_features("HOME!! | MENU!!", set())
    n = quality.PIECE
    field = quality.train_field([([same] * n + [same] * n, 1)] * 10 + [([same] * n + [late] * n, 0)] * 10)
    assert field.viterbi([late] * 6) == [0] * 6 and field.viterbi([same] * 6) == [1] * 6


def test_quality_of_labelled_documents(small):
    docs, labels = small("documents", "0.1"), small("labels", "0.1")
    got = quality.quality(docs, labels).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.99 * len(good)
    assert sum(r["kept"] for r in bad) < 0.05 * len(bad)


def test_quality_of_odd_rows(spark, docs_of, odd_pairs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = quality.quality(docs_of(odd_pairs), labels).collect()
    assert len(got) == len(odd_pairs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    nothing = quality.quality(docs_of(odd_pairs), labels.limit(0)).collect()  # without labels the base rules decide
    assert all(r["kept"] == (not r["base_failed"]) for r in nothing)
    assert quality.quality(docs_of([]), labels).count() == 0
    kept = quality.keep_good(docs_of(odd_pairs), labels)
    assert kept.columns == docs_of([]).columns and kept.count() == sum(r["kept"] for r in got)
