import pytest
from helpers import SF01, one
from pyspark.sql import functions as F

import model
from trawl.functions import text as T
from trawl.operators import grep as G

COUNT_CASES = [
    ("Blue kite, BLUE sky, bluebell", "blue", "default", 3),
    ("Blue kite, BLUE sky, bluebell", "Blue", "exact", 1),
    ("w-i-n-d m!i!l!l", "windmill", "fuzzy", 1),
    ("Jalapeño", "jalapeno", "fuzzy", 1),
    ("two lantrens by the gate", "lantern", "fuzzy", 0),
    ("two lantrn by the gate", "lantern", "fuzzy", 1),
    ("a worn doer", "door", "fuzzy", 1),
    ("a worn doxxr", "door", "fuzzy", 0),
    ("section a of the act", "[a]", "default", 0),
    ("section a of the act", "[a]", "fuzzy", 0),
    ("section [A] of the act [a]", "[a]", "default", 2),
    ("the résumé was short", "resume", "default", 1),
    ("naive Naïve naïve NAIVE NAÏVE", "naive", "default", 5),
    ("Naïve naive", "naïve", "default", 2),
    ("in side streets", "inside", "default", 0),
    ("river\nbank of reeds", "river bank", "default", 1),
    ("ÑANDÚ ñandú nandu", "ñandú", "default", 3),
    ("F# and f#", "F#", "default", 2),
    ("aaaa", "aa", "exact", 2),
    ("", "x", "default", 0),
    ("text", "", "default", 0),
]


@pytest.mark.parametrize("text,kw,mode,expected", COUNT_CASES)
def test_counts_of_cases(spark, text, kw, mode, expected):
    assert one(spark, T.count_matches(F.col("t"), kw, mode), t=text) == expected
    assert model.count(text, kw, mode) == expected


def test_fuzzy_crosses_word_breaks(spark):
    assert one(spark, T.count_matches(F.col("t"), "inside", "fuzzy"), t="in side streets") > 0


def test_folds(spark):
    assert one(spark, T.fold_strict(F.col("t")), t="Crème Brûlée") == "cremebrulee"
    assert one(spark, T.fold_strict(F.col("t")), t="No. 7/b_x") == "no7bx"
    assert one(spark, T.fold_spaces(F.col("t")), t="Größe") == "gro e"
    assert one(spark, T.fold_spaces(F.col("t")), t="Señor -- Peña") == "senor pena"


def test_null_text_counts_zero(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.count_matches("t", "x", "default").alias("c")).first()["c"] == 0
    assert df.select(T.count_matches("t", "xy", "fuzzy").alias("c")).first()["c"] == 0


def test_keyword_with_quote_end(spark):
    assert T.java_quote("a\\Eb") == "\\Qa\\E\\\\E\\Qb\\E"
    assert one(spark, T.count_matches(F.col("t"), "a\\Eb", "exact"), t="xa\\Eb a\\Eb") == 2


SNIPPET_CASES = [
    ("m " * 80 + "Zoë Brontë read aloud" + " n" * 80, "Bronte", "default"),
    ("resume the walk then " + "q " * 70 + "Résumé of the year", "resume", "default"),
    ("north south " * 30 + "west", "south", "default"),
    ("First oak here. " + "padding " * 40 + "second oak there", "oak", "exact"),
    ("nothing of the kind", "qqq", "default"),
    ("in, side door " * 3, "inside", "fuzzy"),
    ("c" * 700 + " key " + "d" * 700, "key", "default"),
    ("\x01ctl\x02 key\tword x", "key", "default"),
]


@pytest.mark.parametrize("text,kw,mode", SNIPPET_CASES)
def test_snippets_equal_sequential_model(spark, text, kw, mode):
    got = one(spark, T.find_snippets(F.col("t"), kw, mode, 3), t=text)
    assert list(got) == model.snippets(text, kw, mode, 3)


def test_snippet_cost_is_linear(spark):
    import time

    def seconds(hits):
        text = ("filler words go here and then the needle again " * hits)
        df = spark.createDataFrame([(text,)], "t string").select(T.find_snippets("t", "needle", "default", 3).alias("s"))
        best = 1e9
        for _ in range(2):
            t = time.time()
            got = df.first()["s"]
            best = min(best, time.time() - t)
        return best, list(got), model.snippets(text, "needle", "default", 3)

    few, got, want = seconds(800)
    assert got == want
    many, got, want = seconds(8000)
    assert got == want
    assert many < 25 * few + 2  # a hundredfold if it were quadratic


@pytest.mark.parametrize("text", ["x" * 5000 + "key" + "y" * 5000, ("q" * 300 + " key\x02 ") * 30, "key " * 400, "a " * 2000 + "key", "key" + " b" * 2000,
                                  "z" * 900 + " key " + "w" * 900 + " key " + "v " * 300])
def test_snippets_of_long_tokens_and_controls(spark, text):
    assert list(one(spark, T.find_snippets(F.col("t"), "key", "default", 3), t=text)) == model.snippets(text, "key", "default", 3)


def test_keyword_table_equals_model(spark):
    lines = ["Café con leche y pan", "the lantern, the lantrens", "ÜBER über", "C++ and c#", "so far away", "ab", "a\\Eb", "key KEY kéy", "ſ long s", "ΑΣ ας"]
    words = ["cafe", "Café", "lantern", "über", "C++", "sofa", "a", "ab", "a\\Eb", "key", "con leche", "zzz", "s", "ας", "kee"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    table = spark.createDataFrame([(w, m) for w in words for m in T.MODES], "keyword string, mode string")
    got = {(r.doc_id, r.keyword, r["mode"]): r["count"] for r in G.keyword_table_grep(docs, table).collect()}
    few = {(r.doc_id, r.keyword, r["mode"]): r["count"] for r in G.multi_keyword_grep(docs, [(w, m) for w in words for m in T.MODES]).collect()}
    assert got == few
    assert G.keyword_table_grep(docs, table.limit(0)).count() == 0


def test_many_keywords_run(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(50).select("doc_id", "text")
    words = docs.select(F.explode(F.split("text", r"\W+")).alias("keyword")).filter("length(keyword) > 3").distinct()
    made = spark.range(10_000).select(F.concat(F.lit("kw"), F.col("id").cast("string")).alias("keyword"))
    table = words.unionByName(made).withColumn("mode", F.lit("exact"))
    assert table.count() > 10_000
    one_word = words.orderBy("keyword").first()["keyword"]
    got = G.keyword_table_grep(docs, table).filter(F.col("keyword") == one_word)
    want = G.grep_lines(docs, one_word, "exact")
    assert sorted((r.doc_id, r.line, r["count"]) for r in got.collect()) == sorted((r.doc_id, r.line, r["count"]) for r in want.collect())


def test_snippet_limits(spark):
    text = "hit " + "w " * 200 + "hit " + "w " * 200 + "hit " + "w " * 200 + "hit"
    got = one(spark, T.find_snippets(F.col("t"), "hit", "default", 2), t=text)
    assert len(got) == 2
    assert one(spark, T.find_snippets(F.col("t"), "hit", "default", 3), t="") == []


def test_snippets_on_documents_equal_model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for kw, mode in [("elle", "default"), ("ete", "default"), ("of, the", "default"), ("That", "exact"),
                     ("thatthe", "fuzzy"), ("of, the", "fuzzy")]:
        rows = docs.select("doc_id", "text", T.find_snippets(F.col("text"), kw, mode, 3).alias("s")).collect()
        bad = [r.doc_id for r in rows if list(r.s) != model.snippets(r.text, kw, mode, 3)]
        assert not bad, (kw, mode, bad[:5])


def test_document_counts_equal_model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    for kw, mode in [("ete", "default"), ("hten", "fuzzy"), ("That", "exact"), ("that the", "default")]:
        rows = docs.select("doc_id", "text", T.count_matches("text", kw, mode).alias("c")).collect()
        assert all(r.c == model.count(r.text, kw, mode) for r in rows), (kw, mode)


LINE_TEXTS = [
    "first\nsecond key\nthird",
    "a key\r\nb\r\nkey c",
    "one\rkey two\rthree key",
    "p1 key\fp2 line\nkey again\f\fkey",
    "   key with spaces   ",
    "k" * 10 + " key " + "x" * 200,
    "key" + "y" * 114,
    "key" + "y" * 118,
    "",
    "   \n  ",
]


@pytest.mark.parametrize("text", LINE_TEXTS)
def test_line_matches_equal_model(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.page, r.line, r["count"], r.snippet) for r in G.grep_lines(df, "key", "default").orderBy("page", "line").collect()]
    assert got == model.line_matches(text, "key", "default")


def test_line_snippet_cut_at_120(spark):
    df = spark.createDataFrame([(1, "key" + "y" * 117), (2, "key" + "y" * 118)], "doc_id long, text string")
    rows = {r.doc_id: r.snippet for r in G.grep_lines(df, "key", "default").collect()}
    assert len(rows[1]) == 120 and not rows[1].endswith("...")
    assert len(rows[2]) == 120 and rows[2].endswith("...")


def test_format_duration(spark):
    df = spark.createDataFrame([(1500,), (90000,), (4230,)], "ms long")
    got = [r.v for r in df.select(T.format_duration("ms").alias("v")).collect()]
    assert got == ["1.50s", "1m 30.00s", "4.23s"]


def test_no_python_udf_in_plans(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    df = G.grep_lines(docs, "elle", "fuzzy")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan


def test_keyword_tables_equal_single_searches_for_keywords_of_any_length(spark, monkeypatch):
    import random

    from trawl.operators import grep as G

    rnd = random.Random(11)
    words = ["".join(rnd.choices("abé", k=rnd.randint(1, 40))) for _ in range(60)]
    def typo(w):
        at = rnd.randrange(len(w) or 1)
        return rnd.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "a" + w[at + 1:], w])
    lines = [" ".join(typo(typo(rnd.choice(words))) or "a" for _ in range(8)) for _ in range(60)] + ["an i++ loop", "an İ++ loop", "STRASSE straße ſo"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keys = [(w, m) for w in words[:24] for m in ("default", "exact", "fuzzy")] + [("İ++", "default"), ("i++", "default"), ("SO", "default"), ("straße", "default")]
    keys = list(dict.fromkeys(keys))
    want = sorted(tuple(r) for r in G.multi_keyword_grep(docs, keys).collect())
    table = spark.createDataFrame(keys, "keyword string, mode string")
    assert sorted(tuple(r) for r in G.keyword_table_grep(docs, table).collect()) == want
    monkeypatch.setattr(G, "BROADCAST_KEYWORDS", 0)
    assert sorted(tuple(r) for r in G.keyword_table_grep(docs, table).collect()) == want


def test_a_very_long_fuzzy_keyword(spark):
    from trawl.operators import grep as G

    word = "abcdefghij" * 300
    near = word[:700] + "x" + word[700:2000] + word[2001:]
    docs = spark.createDataFrame([(1, "some " + near + " here"), (2, word[:-9])], "doc_id long, text string")
    got = G.keyword_table_grep(docs, spark.createDataFrame([(word, "fuzzy")], "keyword string, mode string")).collect()
    assert [(r["doc_id"], r["count"]) for r in got] == [(1, 1)]


def test_keyword_tables_take_time_in_proportion_to_a_line(spark):
    import time

    from trawl.operators import grep as G

    table = spark.createDataFrame([("lantern", "default"), ("the", "exact"), ("kee", "fuzzy")], "keyword string, mode string")

    def seconds(words):
        line = "".join(f"w{i * 7919 % 99991}x the kee " for i in range(words))
        docs = spark.createDataFrame([(1, line)], "doc_id long, text string").checkpoint()
        began = time.time()
        got = {(r["keyword"], r["count"]) for r in G.keyword_table_grep(docs, table).collect()}
        assert got == {("the", words), ("kee", words)}
        return time.time() - began

    seconds(100)
    assert seconds(24_000) < 10 * seconds(2_000) + 3


def test_keyword_tables_on_lines_that_come_twice(spark):
    from trawl.operators import grep as G

    docs = spark.createDataFrame([(1, "a key here"), (1, "a key here"), (None, "kee"), (None, "kee")], "doc_id long, text string")
    table = spark.createDataFrame([("key", "fuzzy"), ("here", "default")], "keyword string, mode string")
    got = sorted((str(r["doc_id"]), r["keyword"], r["count"]) for r in G.keyword_table_grep(docs, table).collect())
    assert got == [("1", "here", 1), ("1", "here", 1), ("1", "key", 1), ("1", "key", 1), ("None", "key", 2)]


@pytest.mark.parametrize("text", ["", "key", "x" * 700 + "key" + "y" * 700, ("q" * 300 + " key\x02 ") * 9, "key " * 300, "é key   KEY kéy" * 60])
def test_literal_snippets_equal_single_ones(spark, text):
    flat = spark.createDataFrame([(text,), (None,)], "t string").select(T.flatten_whitespace(F.col("t")).alias("flat"))
    got = [r.s for r in flat.select(F.explode(T.literal_snippets(F.col("flat"), "key")).alias("s")).collect()]
    hits = flat.select("flat", F.explode(T.literal_starts(F.col("flat"), "key")).alias("s"))
    single = T.build_snippet(F.col("flat"), F.reverse("flat"), F.length("flat"), F.col("s"), F.col("s") + 3)
    assert got == [r.v for r in hits.select(single.alias("v")).collect()]


def test_case_insensitive_counts_of_plain_and_other_texts(spark):
    texts = ["Key kEY keykey", "KEY Key é", "ſo So sO", "a i̇++ I++ i++", "", "aaa AAA", "C++ c++C++"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kw in ("key", "so", "i++", "aa", "C++", "ſo", "É"):
        rows = docs.select("text", T.count_ci("text", kw).alias("ci"), T.count_default("text", kw).alias("d"), F.regexp_count("text", F.lit(T.keyword_regex(kw, "default"))).alias("want")).collect()
        assert all(r.ci == r.want and r.d == model.count(r.text, kw, "default") for r in rows), kw
    plan = docs.select(T.fold_spaces("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan  # ASCII texts are not looked up character by character


@pytest.mark.parametrize("block", [7, 100, 1 << 18])
def test_scans_for_keyword_tables_equal_plain_counts(monkeypatch, block):
    import random

    import numpy as np

    from trawl.operators import keyword_scan as KS

    monkeypatch.setattr(KS, "BLOCK", block)
    rnd = random.Random(block)

    def word(alphabet, n):
        return "".join(rnd.choices(alphabet, k=n)).encode()

    lines = [b"", b"a", b"\0a\0"] + [b" ".join(word("aab", rnd.randint(1, 30)) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    pieces = [x[i : i + n] for x in lines for n in (1, 2, 3, 7, 8, 9, 16, 17, 25) for i in (0, 3) if len(x) >= i + n]
    keys = list(dict.fromkeys([*rnd.sample(pieces, 120), b"aa", b"aaaaaaaaaa", b"a" * 20, b"zz", b"a\0", b"\0"]))
    table = [(100 + 7 * i, m, k, k, k[1:] or None, k) for i, (k, m) in enumerate((k, m) for k in keys for m in ("exact", "default", "fuzzy"))]
    words = sorted({w for x in lines for w in x.split(b" ") if w})[::2]
    fuzzy = [r[0] for r in table if r[1] == "fuzzy"]
    near = {w: rnd.sample(fuzzy, rnd.randint(1, 5)) for w in words}
    times = [rnd.choice([1, 1, 1, 2, 3]) for _ in lines]
    want = []
    for x, n in zip(lines, times, strict=True):
        got = []
        for number, mode, keyword, cased, spaced, strict in table:
            c = x.count({"exact": keyword, "default": cased, "fuzzy": strict}[mode])
            c = max(c, x.count(spaced)) if mode == "default" and spaced else c
            if c:
                got += [(number, c)] * n
            elif mode == "fuzzy" and (c := sum(number in near.get(w, ()) for w in x.split(b" "))):
                got.append((number, c * n))
        want.append(sorted(got))
    one = (np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)]))
    scan = KS.KeywordScan(table, (words, np.array([len(near[w]) for w in words]), np.array([n for w in words for n in near[w]])))
    sizes, numbers, counts = scan.hits([one] * 4, np.array(times))
    pairs = np.split(np.stack([numbers, counts], 1), np.cumsum(sizes)[:-1])
    assert [sorted(map(tuple, p.tolist())) for p in pairs] == want


def test_keyword_tables_of_all_sizes_find_the_same_near_words(spark, monkeypatch):
    lines = ["the lantern lantrens lamtern", "a lanterns' latern", "lntrn", "kez key keys qey ley", "ab", "überall ubreall", "internationalisation internationalizatoin"] * 2
    docs = spark.createDataFrame([(i // 2, x) for i, x in enumerate(lines)], "doc_id long, text string")
    words = ["lantern", "key", "keys", "überall", "internationalisations", "ab", "zzz", "x1"]
    table = spark.createDataFrame([(w, m) for w in words for m in ("fuzzy", "exact")], "keyword string, mode string")
    want = sorted(tuple(r) for r in G.multi_keyword_grep(docs, [(w, m) for w in words for m in ("fuzzy", "exact")]).collect())
    assert len(want) > 20
    assert sorted(tuple(r) for r in G.keyword_table_grep(docs, table).collect()) == want
    monkeypatch.setattr(G, "LOOP_KEYWORDS", 0)
    assert sorted(tuple(r) for r in G.keyword_table_grep(docs, table).collect()) == want
    monkeypatch.setattr(G, "NEAR_WORDS", 0)
    assert sorted(tuple(r) for r in G.keyword_table_grep(docs, table).collect()) == want


def test_keywords_with_a_common_part_take_no_more_time_than_others(spark):
    import time

    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of the same the words as the others "), F.col("id")).alias("text")).checkpoint()

    def seconds(middle):
        table = spark.createDataFrame([(f"{i:04d}{middle}{i:04d}", m) for i in range(4_000) for m in ("exact", "default")], "keyword string, mode string").checkpoint()
        began = time.time()
        assert G.keyword_table_grep(docs, table).count() == 0
        return time.time() - began

    seconds("xyz")
    assert seconds("the") < 3 * seconds("xyz") + 3
