import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trawl.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = "ab Z9é'sß你 \n\t\r\x0b\x1c\x1d\x85\xa0 　​́ΣİǅΩ²٣!?<|>_endoftxsr'd"


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ODD, max_size=40) | st.text(max_size=30))
def test_counts_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    lib = Tokenizer.from_file(BYTE) if not hasattr(test_counts_equal_the_library, "lib") else test_counts_equal_the_library.lib
    test_counts_equal_the_library.lib = lib
    assert tokens.counter(BYTE).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ODD, max_size=40) | st.text(max_size=30))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    lib = Tokenizer.from_file(WORD) if not hasattr(test_ids_equal_the_library, "lib") else test_ids_equal_the_library.lib
    test_ids_equal_the_library.lib = lib
    assert packing.encoder(WORD).ids(text) == array("I", lib.encode(text, add_special_tokens=False).ids).tobytes()


def test_every_whole_token_is_one_token(byte_library):
    whole = tokens.whole_tokens(byte_library)
    assert len(whole) > 40_000
    some = sorted(whole)[::37]
    alone = [t for t in some if len(byte_library.encode(t, add_special_tokens=False).ids) != 1]
    assert not [t for t in alone if len(byte_library.pre_tokenizer.pre_tokenize_str(t)) == 1]


def test_counts_of_documents(docs_of, odd_pairs, small, got, byte_library):
    for df, pairs in ((docs_of(odd_pairs), odd_pairs), (small("documents"), [tuple(r) for r in small("documents").select("doc_id", "text").collect()])):
        want = []
        for i, t in pairs:
            n = len(byte_library.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 512))
        assert got(tokens.count_tokens(df, BYTE)) == sorted(want, key=repr)
    assert tokens.count_tokens(docs_of([]), BYTE).count() == 0


def check_packing(rows, pairs, library, length):
    ids = defaultdict(list)
    for i, t in pairs:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for doc, start, n, crc, total, sequence, offset in rows:
        by_sequence[sequence].append((offset, n))
        by_doc[doc].append((start, n, crc, total))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        want = Counter()
        for v in ids[doc]:
            for s in range(0, len(v), length):
                want[s, len(v[s : s + length]), zlib.crc32(array("I", v[s : s + length]).tobytes()), len(v)] += 1
        assert Counter(parts) == want
    padded = sum(0 if (s := sum(n for _, n in p)) & (s - 1) == 0 else length - s for p in by_sequence.values())
    return padded, sum(n for p in by_sequence.values() for _, n in p)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_packing(docs_of, odd_pairs, small, got, word_library):
    check_packing(got(packing.pack_documents(docs_of(odd_pairs), WORD), *COLUMNS), odd_pairs, word_library, 4096)
    check_packing(got(packing.pack_documents(docs_of(odd_pairs), WORD, length=64), *COLUMNS), odd_pairs, word_library, 64)
    docs = small("documents", "0.01")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    padded, total = check_packing(got(packing.pack_documents(docs, WORD), *COLUMNS), pairs, word_library, 4096)
    assert padded < 0.02 * total
    assert packing.pack_documents(docs_of([]), WORD).count() == 0


def test_sequences_hold_the_ids(docs_of, odd_pairs, word_library):
    pairs = [(i, t) for n, (i, t) in enumerate(odd_pairs) if i is not None and i not in [x for x, _ in odd_pairs[:n]]]
    docs = docs_of(pairs)
    packed = packing.pack_documents(docs, WORD, length=128).cache()
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, packed, WORD, length=128).collect()}
    assert all(len(v) == 128 or len(v) & (len(v) - 1) == 0 for v in made.values())
    ids = {i: [*word_library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in pairs}
    for r in packed.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_histogram_packing_places_everything(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and pattern == sorted(pattern, reverse=True) and count > 0
        for size in pattern:
            placed[size] += count
    assert placed == Counter(histogram)
    # No two packs could have been one: at most one is half empty.
    assert sum(count for pattern, count in patterns if sum(pattern) <= 32) <= 1
