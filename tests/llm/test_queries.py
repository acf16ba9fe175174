"""The registered queries on a whole table, against brute force and their contracts' columns."""

import zlib

import pytest
from test_chat_pipeline import brute as brute_chat
from test_decontam_licenses_sharding import brute_contamination
from test_models import brute_base
from test_simhash import brute_components
from test_tokens_packing import BYTE, COLUMNS, WORD, check_packing
from tokenizers import Tokenizer

import __spark_entry__ as entry
from trawl.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(small):
    return [tuple(r) for r in small("documents").select("doc_id", "text").collect()]


def typed(df):
    return {n: t for n, t in df.dtypes}


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, pairs):
    df = QUERIES["op1_packing"](spark, SF)
    assert typed(df) == {"doc_id": "bigint"} | {c: "bigint" for c in COLUMNS}
    padded, total = check_packing([tuple(r) for r in df.select(*COLUMNS).collect()], pairs, Tokenizer.from_file(WORD), 4096)
    assert padded < 0.05 * total


def test_op2_and_op4(spark, pairs):
    for name, kinds in (("op2_language_id", {"held_out": "boolean", "lang_pred": "string", "score": "double"}),
                        ("op4_toxicity", {"held_out": "boolean", "score": "double", "predicted": "int"})):
        df = QUERIES[name](spark, SF)
        assert typed(df) == {"doc_id": "bigint"} | kinds
        got = df.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in pairs)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)


def test_op3(spark, small, got):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    df = QUERIES["op3_chat_format"](spark, SF)
    assert got(df) == brute_chat([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_op6(spark, small, pairs):
    items = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in QUERIES["op6_decontamination"](spark, SF).collect())
    assert got == sorted((d, n, h, i, c) for d, n, h, i, _, c in brute_contamination(pairs, items))


def test_op7(spark, pairs, got):
    assert got(QUERIES["op7_simhash"](spark, SF)) == brute_components(pairs)


def test_op8(spark, pairs):
    df = QUERIES["op8_sharding"](spark, SF)
    assert typed(df) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = df.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in pairs)
    by_shard = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1


def test_op9(spark, pairs):
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    assert len(got) == len(pairs)
    for doc, text in pairs:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(text)


def test_op10(spark, pairs, got):
    lib = Tokenizer.from_file(BYTE)
    want = [(i, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in pairs]
    assert got(QUERIES["op10_token_counts"](spark, SF)) == sorted(want, key=repr)
