import re
import zlib
from collections import Counter

import pytest

from trawl.llm import decontam, licenses, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(pairs, items, window=13):
    out = []
    for doc, text in pairs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            if not v or item is None:
                continue
            for i in range(max(1, len(v) - window + 1)):
                x = v[i : i + window]
                for j in range(len(w) - len(x) + 1):
                    if w[j : j + len(x)] == x:
                        hit.update(range(j, j + len(x)))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["item_ids"]), r["contaminated"]) for r in df.collect()), key=repr)


def test_contamination(spark, docs_of, odd_pairs):
    base = dict(odd_pairs)[4]
    v = words(dict(odd_pairs)[9])
    items = [(1, base), (2, base), (3, "one"), (4, None), (5, ""), (None, base), (6, " ".join(v[100:130])), (7, " ".join(v[110:140]).upper()), (8, "nothing like it"), (10, "a b c d")]
    bench = spark.createDataFrame([(i, t, "w", 3) for i, t in items], "item_id long, text string, word string, n_words int")
    pairs = [*odd_pairs, (20, " ".join(v[95:135]) + " one one one"), (21, "a a b c d b c d a b c d"), (22, "x " * 400 + " ".join(v[100:113]))]
    assert found(decontam.contamination(docs_of(pairs), bench)) == brute_contamination(pairs, items)
    assert found(decontam.contamination(docs_of(pairs), bench.limit(0))) == brute_contamination(pairs, [])
    assert decontam.contamination(docs_of([]), bench).count() == 0
    clean = decontam.drop_contaminated(docs_of(pairs), bench)
    assert clean.columns == docs_of(pairs).columns
    bad = {(d, n) for d, n, _, _, _, c in brute_contamination(pairs, items) if c}
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted([(d, t) for d, t in pairs if (d, len(words(t))) not in bad], key=repr)


def test_contamination_by_shuffle(spark, docs_of, odd_pairs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    items = [(1, dict(odd_pairs)[4]), (3, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontam.contamination(docs_of(odd_pairs), bench)) == brute_contamination(odd_pairs, items)


def test_contamination_of_tables(small):
    pairs = [tuple(r) for r in small("documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    assert found(decontam.contamination(small("documents"), small("benchmark"))) == brute_contamination(pairs, items)


def brute_licenses(pairs, templates, percent):
    def normal(t):
        return re.sub(r"(?:[^\w\n]|_)+", " ", (t or "").lower())
    def grams(t):
        w = t.split()
        return Counter(zip(w, w[1:]))
    known = {k: grams(normal(t)) for k, t in templates}
    out = []
    for doc, text in pairs:
        n = normal(text)
        hits = []
        for unit in [n, *re.split("\n *\n[ \n]*", n), *n.split("\n")]:
            a = grams(unit)
            for k, b in known.items():
                total = sum(a.values()) + sum(b.values())
                if a and b and 200 * sum((a & b).values()) >= percent * total:
                    hits.append((-round(2 * sum((a & b).values()) / total, 6), k))
        best = min(hits, default=(None, None))
        out.append((doc, best[1], -best[0] if hits else None, len(hits), ",".join(sorted({k for _, k in hits}))))
    return sorted(out, key=repr)


def test_licences(spark, docs_of, odd_pairs):
    mit = licenses.TEMPLATES["MIT"]
    pairs = [*odd_pairs, (30, "Some prose.\nReleased under the MIT License.\nMore prose here."), (31, mit), (32, mit.replace("free of charge", "gratis")),
             (33, "Intro\n\n" + mit[:300] + "\n" + mit[300:] + "\n\nOutro"), (34, "licensed under cc by nc 4.0"), (34, "licensed under cc by nc 4.0"), (35, "of of of of of")]
    templates = [*licenses.TEMPLATES.items(), ("twice", "of of of of"), ("short", "MIT"), ("blank", "")]
    known = spark.createDataFrame(templates, "license_id string, text string")
    got = sorted((tuple(r) for r in licenses.scan(docs_of(pairs), known).collect()), key=repr)
    assert got == brute_licenses(pairs, templates, 80)
    assert {r[0]: r[1] for r in got if r[1]}[32] == "MIT"
    assert licenses.scan(docs_of([]), known).count() == 0
    assert {r["license_id"] for r in licenses.scan(docs_of(pairs), known.limit(0)).collect()} == {None}


def test_licences_of_tables(spark, small):
    pairs = [tuple(r) for r in small("documents", "0.01").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in licenses.scan(small("documents", "0.01"), licenses.templates(spark)).collect()), key=repr)
    assert got == brute_licenses(pairs, licenses.TEMPLATES.items(), 80)


#: Licences as they stand in files: paragraphs, comment signs with separator lines.
MIT_PARAGRAPHS = re.sub(r"(conditions:|of the Software\.) (?=The above|THE SOFT)", r"\1\n\n", licenses.TEMPLATES["MIT"])
GPL_PARAGRAPHS = re.sub(r"(version\.|details\.) (?=This program|You)", r"\1\n\n", licenses.TEMPLATES["GPL-3.0-header"])
CODE = "\n".join(f"def function_{i}(a, b): return a * {i} + b" for i in range(60))


def best_stretch(text, template, percent=80):
    """The best Dice of any stretch of words with a template, if it is enough."""
    def words(t):
        return re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    def grams(w):
        return list(zip(w, w[1:]))
    a, b = grams(words(text)), Counter(grams(words(template)))
    t, best = sum(b.values()), 0
    for i in range(len(a)):
        seen, common = Counter(), 0
        for size, g in enumerate(a[i : i + 2 * t], 1):
            seen[g] += 1
            common += seen[g] <= b[g]
            if 200 * common >= percent * (size + t):
                best = max(best, 2 * common / (size + t))
    return round(best, 6) or None


def test_licences_inside_documents(spark, docs_of):
    assert MIT_PARAGRAPHS.count("\n\n") == 2 and GPL_PARAGRAPHS.count("\n\n") == 1
    wrapped = "/*\n" + "\n".join(" * " + " ".join(p[i : i + 9]) for q in GPL_PARAGRAPHS.split("\n\n") for p in [q.split()] for i in range(0, len(p), 9)) + "\n *\n */\n"
    separated = "/*\n" + "\n *\n".join(" * " + q for q in MIT_PARAGRAPHS.split("\n\n")) + "\n */\n"
    notice = "Some sentence here about the code. Released under the MIT License. See details."
    pairs = [
        (1, CODE + "\n\n" + MIT_PARAGRAPHS + "\n\n" + CODE), (2, wrapped + CODE), (3, separated + CODE), (4, notice), (4, notice), (None, notice),
        (5, notice + "\n" + CODE + "\n" + notice), (6, "Released under the MIT License.\n" + CODE + "\n" + notice), (7, CODE), (8, "the software and the software or the " * 300),
        (9, CODE + " " + MIT_PARAGRAPHS.replace("free of charge", "gratis") + " " + CODE + "\n\n" + GPL_PARAGRAPHS + "\n" + CODE),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(pairs), licenses.templates(spark)).collect()}
    for doc, text in pairs:
        want = {k: d for k, t in licenses.TEMPLATES.items() if (d := best_stretch(text, t))}
        r = got[doc]
        assert r["license_ids"] == ",".join(sorted(want)), doc
        assert (r["license_id"], r["dice"]) == min(((k, d) for k, d in want.items()), key=lambda x: (-x[1], x[0]), default=(None, None)), doc
    assert {k: r["license_ids"] for k, r in got.items()} == {1: "MIT", 2: "GPL-3.0-header", 3: "MIT", 4: "MIT-notice", None: "MIT-notice", 5: "MIT-notice",
                                                             6: "MIT-notice", 7: "", 8: "", 9: "GPL-3.0-header,MIT"}
    assert {k: r["n_matches"] for k, r in got.items() if r["n_matches"]} == {1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 2, 6: 2, 9: 2}


def test_licences_inside_documents_by_shuffle(spark, docs_of, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_WANTED", 0)
    monkeypatch.setattr(licenses, "BROADCAST_BIGRAMS", 0)
    got = licenses.scan(docs_of([(1, CODE + MIT_PARAGRAPHS + CODE), (2, CODE)]), licenses.templates(spark)).collect()
    assert {r["doc_id"]: r["license_ids"] for r in got} == {1: "MIT", 2: ""}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1001])
def test_permutation(n):
    assert sorted(sharding.permute_py(x, n, 3) for x in range(n)) == list(range(n))


def test_shards(spark, docs_of, odd_pairs, small):
    for df, pairs in ((docs_of(odd_pairs), odd_pairs), (small("documents"), [tuple(r) for r in small("documents").select("doc_id", "text").collect()])):
        got = sharding.shard_documents(df, 7, seed=11).collect()
        order = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, i) for i, t in pairs)
        want = []
        for row, (_, crc, size, i) in enumerate(order):
            place = sharding.permute_py(row, len(order), 11)
            want.append((i, size, crc, place % 7, place // 7))
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=repr) == sorted(want, key=repr)
        per = Counter(r["shard"] for r in got)
        assert max(per.values()) - min(per.get(s, 0) for s in range(7)) <= 1
    assert sharding.shard_documents(docs_of([]), 7).count() == 0
    one = sharding.shard_documents(docs_of([(1, "x")] * 50), 7, seed=2).collect()  # one id for all rows
    assert sorted((r["shard"], r["slot"]) for r in one) == sorted((p % 7, p // 7) for p in range(50))
    # The same places whatever the partitions.
    a = sharding.shard_documents(small("documents").repartition(13), 7).select("doc_id", "shard", "slot").collect()
    b = sharding.shard_documents(small("documents").coalesce(1), 7).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))

