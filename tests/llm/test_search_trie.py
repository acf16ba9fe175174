"""Operators 11 to 13 against brute force, on odd rows and with small blocks, shards and skeletons."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from trawl.llm import lexical, prefix_trie, topk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_ranking(pairs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in pairs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score long")


@pytest.fixture(scope="module")
def odd_items():
    return [(1, "an be CO du"), (2, None), (3, ""), (4, "!!! ..."), (5, "élan ÀÉ 你好 one two"), (6, "x y z w"), (7, "an an an be"), (7, "an an an be"), (None, "fi go")]


def test_ranking_on_odd_rows(spark, docs_of, odd_pairs, odd_items, got):
    df = lexical.rank_documents(docs_of(odd_pairs), items_of(spark, odd_items))
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(df) == brute_ranking(odd_pairs, odd_items)


def test_full_index_small_blocks_and_many_ties(spark, docs_of, got):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    pairs = [(rnd.randrange(10**6), " ".join(rnd.choices(words, weights, k=rnd.randint(1, 80)))) for _ in range(1500)]
    pairs += [(10**6 + i, "w3 w9 w50 w59") for i in range(300)]  # copies: the least ids win
    rnd.shuffle(pairs)
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(20)] + [(99, "w3 w9 w50 w59")]
    docs = docs_of(pairs).repartition(3)
    want = brute_ranking(pairs, items)
    index = lexical.build_index(docs, None, shard_docs=256, block=8)
    asked = spark.createDataFrame([(n, sorted({t.encode() for t in terms(x)})) for n, (_, x) in enumerate(items)], "item long, terms array<binary>")
    found = lexical.search(index, asked, 10, block=8, window=64, item_block=7)
    assert got(found) == sorted(((n, r, d, s) for n, (i, _) in enumerate(items) for j, r, d, s in want if j == i), key=repr)
    # the same without a vocabulary, and postings that end a shard
    assert got(lexical.rank_documents(docs, items_of(spark, items), vocabulary=0)) == want
    few = lexical.build_index(docs, {b"w3", b"w59"}, shard_postings=100, block=8)
    assert {bytes(r["term"]) for r in few.select("term").distinct().collect() if r["term"]} == {b"w3", b"w59"}


def test_block_maxima_reject_before_unpacking():
    """One rare, telling list and one long list of which most blocks can't matter: those stay packed."""
    n = 6400
    tfs = [1] * n
    plain = lexical.array("q", [50] * n)
    rows = list(lexical.invert(0, list(range(n)), plain, lexical.array("i", [0] * n + [1] * 40),
                               lexical.np.concatenate((lexical.np.arange(n), lexical.np.arange(0, 320, 8))),
                               lexical.array("q", [*tfs, *[3] * 40]), [b"common", b"rare"], 128))
    m = lexical.length_part(lexical.np.frombuffer(rows[0]["last"], lexical.np.int64), n, 50 * n)
    lists = {r["term"]: lexical._List(r, n, 50 * n, m, 128) for r in rows[1:]}
    heap = lexical.Heap(10)
    ids = lexical.np.arange(n)
    lexical.search_shard([(5, lists[b"common"]), (5000, lists[b"rare"])], heap, ids < 0, ids, 1024)
    assert list(heap.ids) == list(range(0, 80, 8))
    assert lists[b"common"].done.sum() < len(lists[b"common"].done) / 2


def test_stretches_of_a_long_text(monkeypatch):
    text = ("Ab cd,EF " * 500 + "x" * 300).encode()
    want = Counter(text.translate(lexical._AS_TERM).split())
    monkeypatch.setattr(lexical, "STRETCH", 64)
    assert lexical.term_counts(text) == want


def test_ranking_of_empty_tables(spark, docs_of, odd_items):
    assert lexical.rank_documents(docs_of([]), items_of(spark, odd_items)).count() == 0
    assert lexical.rank_documents(docs_of([(1, "an be")]), items_of(spark, [])).count() == 0
    assert lexical.rank_documents(docs_of([(1, None), (2, "--")]), items_of(spark, odd_items)).count() == 0


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = __import__("hashlib").md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), digest, role, text))
    for x in convs.values():
        x.sort(key=lambda t: t[:2])
    plain = {c: [(r, t) for _, _, r, t in x] for c, x in convs.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple(plain.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string, kind string, path long, shard int"


def conversations(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV).repartition(parts)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_trie_with_many_copies(spark, got, partitions):
    """Random short vocabularies give shared prefixes; a third of all conversations are one and the same."""
    rnd = random.Random(partitions)
    rows = []
    for c in range(-150, 250):
        if rnd.random() < 0.1:
            continue
        same = rnd.random() < 0.35
        for t in range(6 if same else rnd.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"copy {t}" if same else rnd.choice(["a", "bb", "ééé", "dddd 😀"])))
    assert got(prefix_trie.conversation_trie(conversations(spark, rows), partitions=partitions)) == brute_trie(rows)


def test_trie_of_equal_conversations_over_shards(spark, got):
    """Without heads: all paths are equal, so every node is on the skeleton and ids span all shards."""
    rows = [(c, t, "user", "x" * t) for c in range(300) for t in range(4)]
    paths = prefix_trie.turn_paths(conversations(spark, rows))
    df = prefix_trie.trie(paths, 16)
    ends = sha256(",".join(map(str, range(300))).encode()).hexdigest()
    none = sha256(b"").hexdigest()
    assert got(df) == sorted(((0, d, 0 if d else None, 300, int(d < 4), 1, 299 * sum(range(max(d - 1, 0), 4)), ends if d == 4 else none) for d in range(5)), key=repr)


def test_trie_on_odd_rows(spark, got):
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", ""), (100, 3, "user", "a"),
            (100, None, "x", "y"), (None, 0, "user", "lost"), (7, 0, "u", "ser"), (8, 0, "us", "er"), (101, 0, "user", "long " * 50_000),
            (205, 0, "user", "a"), (-3, 2, "user", "n"), (-3, 1, "user", "m")]
    df = prefix_trie.conversation_trie(conversations(spark, rows))
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert got(df) == brute_trie(rows)
    assert prefix_trie.conversation_trie(conversations(spark, [])).count() == 0


def test_skeleton_is_what_neighbours_share():
    a, b, c = (bytes([x]) * prefix_trie.DIGEST for x in (1, 2, 3))
    children, parents = prefix_trie.skeleton([(5, a + b + c, c), (0, a, a + b), (9, c + a, c + b)])
    assert children == {(0, a): 1, (1, b): 2, (0, c): 3} and parents == [-1, 0, 1, 0]
    assert prefix_trie.common_turns(a + b + c, a + b + a) == 2 and prefix_trie.common_turns(b"", a) == 0


def brute_top(rows, k=5):
    good = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            good.append((n, i, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, q in good:
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m, j) for m, j, v in good if m != n)
            out += [(i, r + 1, x[4], max(-2**63, min(2**63 - 1, -x[0]))) for r, x in enumerate(found[:k])]
    return sorted(out, key=repr)


VEC = "vec_id long, embedding array<double>, label int, score long, id long, row long"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VEC).coalesce(1 if parts == 1 else parts)


def test_top_k_with_small_shards_and_ties(spark, got):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.gauss(0, 0.3)]) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, rows[150][1]) for i in range(60)]  # copies of a query's vector
    want = brute_top(rows)
    for shard, block in ((16, 4), (4096, 2048)):
        df = topk.top_k(vectors(spark, rows), shard=shard, query_block=block)
        assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
        assert got(df) == want


def test_top_k_on_odd_rows(spark, got):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf]), (300, []), (350, [1e300, -1e300]),
            (400, [3.0]), (None, [1.0, 2.0]), (7, [1e307, 2.0]), (8, [-0.001, 0.001]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (-50, [-1.0, -1.0, 5.0]), (9, [1e306])]
    assert got(topk.top_k(vectors(spark, rows, 1))) == brute_top(rows)
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(50, [1.0])])).count() == 0


def test_threshold_stops_early_where_vectors_are_clustered():
    np = topk.np
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(0, 20, (4096, 8))).astype(int).astype(float)
    x[:10] += 400
    lists = np.argsort(x, axis=0, kind="stable").T
    best = topk.Best(5)
    none = np.zeros(4096, dtype=bool)
    ids = np.arange(4096)
    depth = topk.threshold_search(x[0], 0, x, lists, none, ids, ids, best, [64, 128, 4096])
    assert depth == 64 and set(best.ids) <= set(range(1, 10))
