import random
from itertools import combinations

import numpy as np
import xxhash

from trawl.llm import simhash
from trawl.llm.components import components


def brute_fingerprint(text, n=4):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, bits=4, n=4):
    fps = [brute_fingerprint(t, n) for _, t in pairs]
    root = list(range(len(pairs)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(pairs)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(pairs)), key=repr)


def test_golay_keys():
    keys = simhash.golay_keys()
    count = (keys >= 0).sum(axis=1)
    assert set(count) == {1, 6}
    as_sets = [frozenset(k[k >= 0]) for k in keys]
    flips = [0] + [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)]
    rnd = random.Random(1)
    for v in rnd.sample(range(1 << 16), 3000):
        assert all(as_sets[v] & as_sets[v ^ f] for f in flips)


def test_fingerprints_within_four_bits_share_a_key():
    rnd = random.Random(2)
    for _ in range(400):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        at, keys = simhash.keys_of(np.array([a, b], dtype=np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(-80, 80), rnd.randint(-80, 80)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 700)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_with_small_blocks_and_a_dense_group(spark):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(600)} | {rnd.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1}
    signed = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    whole = simhash.forest(np.array(signed), 4)
    def groups(edges):
        root = {x: x for x in signed}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for x in signed:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))
    for block in (simhash.BLOCK, 50):
        found = [tuple(r) for r in simhash.links(df, 4, block).collect()]
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in found)
        assert groups(found) == groups(whole)


def test_near_duplicates(docs_of, odd_pairs, small, got):
    assert got(simhash.near_duplicates(docs_of(odd_pairs))) == brute_components(odd_pairs)
    pairs = [tuple(r) for r in small("documents", "0.01").select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(small("documents", "0.01"))) == brute_components(pairs)
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_one_of_each_group_stays(docs_of, odd_pairs, got):
    docs = docs_of(odd_pairs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    classes = brute_components(odd_pairs)
    assert len(rows) == len({c for _, _, c in classes if c is not None}) + len({f for d, f, c in classes if c is None})
    assert sorted(i for i, _ in rows if i is not None) == sorted({c for _, _, c in classes if c is not None})
    again = [(1, "a b c"), (1, "a b c"), (2, "x y z"), (1, "q r s t u v")]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(again)).collect()) == [(1, "a b c"), (1, "q r s t u v"), (2, "x y z")]
