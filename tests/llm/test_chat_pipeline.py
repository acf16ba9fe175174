import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from trawl.llm import chat


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for conv, turns in out.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        control = sum(len(r) + len(t) + sum(c in "\\<>" for c in r + t) + len("<turn ></turn>\n") for r, t in turns)
        want.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), control))
    return sorted(want, key=repr)


MESSAGES = "conv_id long, turn long, role string, text string, formatted string, loss_start long"


def test_digests_of_a_table_and_odd_rows(spark, small, got):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(chat.digests(chat.format_conversations(small("conversations")))) == brute(rows)
    said = r"\### Assistant: </turn> ok"
    odd = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"),
           (2, 5, "assistant", "<turn user>\\<\\l</turn>\n<image 0>"), (None, 0, "user", "a"), (None, 1, "assistant", "é😀" * 20_000), (3, 0, "sys>tem\\", ""), (4, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "f", 1) for r in odd], MESSAGES)
    assert got(chat.digests(chat.format_conversations(df))) == brute(odd)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_a_conversation_over_many_batches(spark, got):
    rnd = random.Random(1)
    rows = [(1, i, rnd.choice(["user", "assistant"]), f"text {i} <") for i in range(25_000)] + [(2, 0, "user", "x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(chat.digests(chat.format_conversations(df))) == brute(rows)


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\<>lg/turn \n", max_size=30)), max_size=5))
def test_round_trip(messages):
    out = "".join(chat.format_message(r, [{"type": "text", "text": t}])["formatted"] for r, t in messages)
    assert list(chat.read_back(out)) == messages


def test_typed_parts(spark):
    parts = [("text", "look <", None, None, None, None, None), ("image", None, "s3://a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.0, None),
             ("document", "its text", "c.pdf", None, None, None, 3), (None, " end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = chat.format_conversations(df, parts_col="parts").orderBy("turn").collect()
    assert a["formatted"] == "<turn assistant>look \\l<image 0><audio 1><document 2>its text end</turn>\n"
    assert [tuple(x) for x in a["attachments"]] == [(0, "image", "s3://a.png", 3), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 768)]
    assert a["expanded_tokens"] == 796 and a["formatted"][a["loss_start"] : a["loss_end"]] == "look \\l<image 0><audio 1><document 2>its text end"
    assert b["formatted"] == "<turn user></turn>\n" and b["loss_start"] is None and not b["attachments"]
    assert list(chat.read_back(a["formatted"])) == [("assistant", "look <its text end")]
    with pytest.raises(ValueError):
        chat.format_message("user", [{"type": "video"}])


def test_pipeline_stages_work_on_what_came_before(spark):
    from test_decontam_licenses_sharding import brute_contamination
    from test_simhash import brute_components
    from test_tokens_packing import COLUMNS, WORD, check_packing
    from tokenizers import Tokenizer

    from trawl.llm import quality, toxicity
    from trawl.llm.common import table

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_dedup", "decontamination", "packing"]
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    stage = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality.quality(docs, labels).filter("kept").collect()}
    one = stage["quality_rules"](spark, docs, sf).cache()
    assert one.columns == docs.columns and pairs(one) == [p for p in pairs(docs) if p[0] in kept]
    clean = {r["doc_id"] for r in toxicity.toxicity(one, labels).filter("predicted = 0").collect()}
    two = stage["toxicity"](spark, one, sf).cache()
    assert two.columns == docs.columns and pairs(two) == [p for p in pairs(one) if p[0] in clean]
    heads = {c for _, _, c in brute_components(pairs(two))}
    three = stage["simhash_dedup"](spark, two, sf).cache()
    assert three.columns == docs.columns and pairs(three) == [p for p in pairs(two) if p[0] in heads]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination(pairs(three), items) if r[-1]}
    four = stage["decontamination"](spark, three, sf).cache()
    assert four.columns == docs.columns and pairs(four) == [p for p in pairs(three) if p[0] not in bad]
    packed = corpus_pipeline.run(spark, sf)
    check_packing([tuple(r) for r in packed.select(*COLUMNS).collect()], pairs(four), Tokenizer.from_file(WORD), 4096)


def test_stages_and_pipeline_of_empty_tables(spark, tmp_path):
    from trawl.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_without_labels_or_items(spark, docs_of, odd_pairs):
    from trawl.llm import decontam, quality, simhash, toxicity
    from trawl.llm.common import table

    docs = docs_of(odd_pairs)
    labels, items = (table(spark, "/root/testdata/sf0.001", n).limit(0) for n in ("labels", "benchmark"))
    assert toxicity.drop_toxic(docs, labels).count() == len(odd_pairs)
    assert decontam.drop_contaminated(docs, items).count() == len(odd_pairs)
    assert quality.keep_good(docs, labels).count() == quality.quality(docs, labels).filter("NOT base_failed").count()
    assert simhash.keep_one(docs.limit(0)).count() == 0
