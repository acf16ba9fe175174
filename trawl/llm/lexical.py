"""Ranked lexical search by Block-Max MaxScore over a sharded index of compressed posting blocks.

Each task inverts the documents it reads into shards of bounded size.  A shard holds its document
ids and lengths and one row per term: blocks of 128 postings, gaps and frequencies packed to the
least width, and for each block its competitive (frequency, length) pairs.  Those give the exact
largest score of a block for any corpus statistics, so the index needs none.

For a query, lists are ordered by their largest score in the shard.  Those that together stay below
the k-th best score so far are non-essential: documents found only there are never looked at.
Candidates come from the essential lists, a window of documents at a time, and the block maxima of the
non-essential lists reject most of them before any of those blocks is unpacked.  A task carries its
heap from shard to shard, and the heaps of all tasks are merged at the end.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut, fresh, global_index, ship

BLOCK = 128  # postings of a block
WINDOW = 8192  # documents of a window of candidates
SHARD_DOCS = 1 << 16  # documents of a shard
SHARD_POSTINGS = 4_000_000  # postings of a shard
STRETCH = 1 << 20  # bytes of a text that are cut into words at a time
ITEM_BLOCK = 512  # queries of one pass over the index
VOCABULARY = 500_000  # up to so many query terms only their lists are built, else all
#: Every byte as terms have it: A-Z in lower case, other ASCII than letters and digits as a space.
_AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("first", pa.binary()), ("last", pa.binary()),
    ("pair_at", pa.binary()), ("pair_tf", pa.binary()), ("pair_n", pa.binary()), ("at", pa.binary()), ("payload", pa.binary())])
_INDEX_DDL = "shard long, term binary, n long, total long, first binary, last binary, pair_at binary, pair_tf binary, pair_n binary, at binary, payload binary"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text, a stretch at a time."""
    flat = text.translate(_AS_TERM)
    if len(flat) <= STRETCH:
        return Counter(flat.split())
    counts, at = Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + STRETCH)
        end = len(flat) if end < 0 else end
        counts.update(flat[at:end].split())
        at = end
    return counts


def _packed(values: np.ndarray) -> bytes:
    """One byte for the width, then the numbers."""
    for kind in ("u1", "<u2", "<u4"):
        if int(values.max()) <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()
    return b"\x08" + values.astype("<u8").tobytes()


def _unpacked(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = data[0]
    return np.frombuffer(data[1 : 1 + n * width], f"<u{width}").astype(np.int64), data[1 + n * width :]


def invert(shard: int, ids: list, lengths: array, terms: array, ordinals: np.ndarray, tfs: array, names: list[bytes], block: int) -> Iterator[dict]:
    """The rows of a shard: its documents, then its lists."""
    n_of = np.frombuffer(lengths, np.int64)
    null = np.array([i is None for i in ids], dtype=np.uint8)
    yield {"shard": shard, "n": len(ids), "total": int(n_of.sum()), "first": null.tobytes(),
           "payload": np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(), "last": n_of.tobytes()}
    term = np.frombuffer(terms, np.int32)
    order = np.argsort(term, kind="stable")
    term, at, tf = term[order], ordinals[order], np.frombuffer(tfs, np.int64)[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term))
    place = np.arange(len(term)) - np.repeat(starts, ends - starts)
    opens = place % block == 0
    block_of = np.cumsum(opens) - 1
    gaps = np.diff(at, prepend=0)
    gaps[opens] = 0
    # Competitive pairs: by length, each frequency above all those of shorter documents.
    by = np.lexsort((-tf, n_of[at], block_of))
    rising = (block_of[by] << 40) + tf[by]
    competitive = by[np.concatenate(([True], rising[1:] > np.maximum.accumulate(rising)[:-1]))]
    pair_block, pair_tf, pair_n = block_of[competitive], tf[competitive], n_of[at[competitive]]
    block_at = np.append(np.flatnonzero(opens), len(term))
    pair_starts = np.searchsorted(pair_block, np.arange(len(block_at)))
    for s, e in zip(starts, ends, strict=True):
        b0, b1 = block_of[s], block_of[e - 1] + 1
        packed = [_packed(gaps[x:y]) + _packed(tf[x:y]) for x, y in zip(block_at[b0:b1], block_at[b0 + 1 : b1 + 1], strict=True)]
        p0, p1 = pair_starts[b0], pair_starts[b1]
        yield {"shard": shard, "term": names[term[s]], "n": int(e - s), "first": at[block_at[b0:b1]].astype("<i4").tobytes(),
               "last": at[block_at[b0 + 1 : b1 + 1] - 1].astype("<i4").tobytes(), "pair_at": (pair_starts[b0:b1] - p0).astype("<i4").tobytes(),
               "pair_tf": pair_tf[p0:p1].tobytes(), "pair_n": pair_n[p0:p1].tobytes(),
               "at": np.cumsum([0, *map(len, packed)]).astype("<i8").tobytes(), "payload": b"".join(packed)}


def _indexed(known, shard_docs: int, shard_postings: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shards = TaskContext.get().partitionId(), 0
        given = None if known is None else known.value
        only = None if given is None else given.keys()

        def empty():
            return [], array("q"), array("i"), array("q"), array("q"), ({} if given is None else given)

        ids, lengths, terms, per_doc, tfs, place = empty()

        def rows():
            names = list(place)
            ordinals = np.repeat(np.arange(len(ids)), np.frombuffer(per_doc, np.int64))
            made = list(invert(part << 33 | shards, ids, lengths, terms, ordinals, tfs, names, block)) if terms else [
                next(invert(part << 33 | shards, ids, lengths, terms, ordinals, tfs, names, block))]
            for i in range(0, len(made), 10_000):
                x = made[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in x], f.type) for f in _INDEX], schema=_INDEX)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(text.as_py() or b"")
                if not counts:
                    continue
                ids.append(doc)
                lengths.append(sum(counts.values()))
                found = list(counts) if only is None else list(only & counts.keys())
                if only is None:
                    for t in found:
                        place.setdefault(t, len(place))
                per_doc.append(len(found))
                terms.extend(map(place.__getitem__, found))
                tfs.extend(map(counts.__getitem__, found))
                if len(ids) >= shard_docs or len(terms) >= shard_postings:
                    yield from rows()
                    shards += 1
                    ids, lengths, terms, per_doc, tfs, place = empty()
        if ids:
            yield from rows()
    return run


def build_index(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text",
                shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, block: int = BLOCK) -> DataFrame:
    """The index of whole texts, written to the shared checkpoint folder; of the lists of ``terms`` if given, else of all.

    ``id_col`` is a whole number.  Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case.
    Documents without a term are not in it.  A shard ends after ``shard_docs`` documents or ``shard_postings`` postings
    and lies in one partition, its document row first."""
    spark = docs.sparkSession
    ship(spark)
    known = None if terms is None else spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted(terms))})
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return cut(read.mapInArrow(_indexed(known, shard_docs, shard_postings, block), _INDEX_DDL))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """10 + floor(90 * n * N / L), without overflow."""
    if 90 * n_docs * int(n.max(initial=0)) < 2**63:
        return 10 + 90 * n_docs * n // total
    return np.array([10 + 90 * n_docs * int(x) // total for x in n], dtype=np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _List:
    """A term's list in a shard.  Blocks are unpacked when first asked for."""

    def __init__(self, row: dict, n_docs: int, total: int, m: np.ndarray, block: int):
        self.block, self.df, self.m, self.row = block, row["n"], m, row
        self.first, self.last = np.frombuffer(row["first"], "<i4"), np.frombuffer(row["last"], "<i4")
        pairs = impact(np.frombuffer(row["pair_tf"], np.int64), length_part(np.frombuffer(row["pair_n"], np.int64), n_docs, total))
        self.most = np.maximum.reduceat(pairs, np.frombuffer(row["pair_at"], "<i4"))
        self.bound = int(self.most.max())
        self.at = np.frombuffer(row["at"], "<i8")
        self.done = np.zeros(len(self.first), dtype=bool)
        self.docs = np.zeros(self.df, dtype=np.int64)
        self.impacts = np.zeros(self.df, dtype=np.int64)

    def unpack(self, blocks: np.ndarray) -> int:
        todo = blocks[~self.done[blocks]]
        for b in todo:
            s, e = b * self.block, min(self.df, (b + 1) * self.block)
            gaps, rest = _unpacked(memoryview(self.row["payload"])[self.at[b] : self.at[b + 1]], e - s)
            tf, _ = _unpacked(rest, e - s)
            at = self.first[b] + np.cumsum(gaps)
            self.docs[s:e] = at
            self.impacts[s:e] = impact(tf, self.m[at])
        self.done[todo] = True
        return len(todo)

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        b0, b1 = np.searchsorted(self.last, lo), np.searchsorted(self.first, hi)
        if b0 >= b1:
            return self.docs[:0], self.impacts[:0]
        self.unpack(np.arange(b0, b1))
        s, e = b0 * self.block, min(self.df, b1 * self.block)
        x, y = s + np.searchsorted(self.docs[s:e], (lo, hi))
        return self.docs[x:y], self.impacts[x:y]

    def block_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each document, and the largest impact there (0: no block does)."""
        b = np.searchsorted(self.last, docs)
        inside = b < len(self.last)
        b = np.minimum(b, len(self.last) - 1)
        return b, np.where(inside & (self.first[b] <= docs), self.most[b], 0)

    def impacts_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of ascending documents, each within its block."""
        out = np.zeros(len(docs), dtype=np.int64)
        used = np.unique(blocks)
        self.unpack(used)
        for b, x, y in zip(used, np.searchsorted(blocks, used), np.searchsorted(blocks, used, "right"), strict=True):
            s, e = b * self.block, min(self.df, (b + 1) * self.block)
            at = s + np.minimum(np.searchsorted(self.docs[s:e], docs[x:y]), e - s - 1)
            out[x:y] = np.where(self.docs[at] == docs[x:y], self.impacts[at], 0)
        return out


class Heap:
    """The k best (score, id), ties by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.nulls, self.ids = (np.zeros(0, dtype=t) for t in (np.int64, bool, np.int64))

    @property
    def least(self) -> int:
        """A score that a document must reach; it must be above 0 in any case."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def put(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        s, n, i = (np.concatenate(x) for x in ((self.scores, scores), (self.nulls, nulls), (self.ids, ids)))
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.nulls, self.ids = s[order], n[order], i[order]


def search_shard(lists: list[tuple[int, _List]], heap: Heap, nulls: np.ndarray, ids: np.ndarray, window: int) -> None:
    """Block-Max MaxScore of one query, given as (weight, list), over one shard."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    sums = np.cumsum([w * x.bound for w, x in lists])
    for lo in range(0, len(ids), window):
        hi = min(lo + window, len(ids))
        parted = int(np.searchsorted(sums, heap.least))  # lists before it can't reach the heap together
        if parted == len(lists):
            return
        scores, seen = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=bool)
        for w, x in lists[parted:]:
            docs, impacts = x.between(lo, hi)
            scores[docs - lo] += w * impacts
            seen[docs - lo] = True
        rest = lists[:parted]
        found = np.flatnonzero(seen & (scores + (sums[parted - 1] if parted else 0) >= heap.least))
        total, docs = scores[found], found + lo
        blocks, most = [], []
        for w, x in rest:
            b, m = x.block_of(docs)
            blocks.append(b)
            most.append(w * m)
        above = sum(most, np.zeros(len(docs), dtype=np.int64))
        for i in range(len(rest) - 1, -1, -1):
            keep = total + above >= heap.least
            total, docs, above = total[keep], docs[keep], above[keep]
            for j in range(i + 1):
                blocks[j], most[j] = blocks[j][keep], most[j][keep]
            inside = most[i] > 0
            w, x = rest[i]
            above = above - most[i]
            total[inside] += w * x.impacts_of(docs[inside], blocks[i][inside])
        keep = total >= heap.least
        if keep.any():
            heap.put(total[keep], nulls[docs[keep]], ids[docs[keep]])


def _searched(job, k: int, block: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, total, items, weights = job.value
        heaps = [Heap(k) for _ in items]
        docs, lists = None, {}

        def finish():
            if docs is None:
                return
            null, ids = docs
            for heap, terms in zip(heaps, items, strict=True):
                search_shard([(weights[t], lists[t]) for t in terms if t in lists], heap, null, ids, window)

        m = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    finish()
                    docs, lists = (np.frombuffer(row["first"], np.uint8).astype(bool), np.frombuffer(row["payload"], np.int64)), {}
                    m = length_part(np.frombuffer(row["last"], np.int64), n_docs, total)
                elif weights.get(row["term"], 0) > 0:
                    lists[row["term"]] = _List(row, n_docs, total, m, block)
        finish()
        for i, heap in enumerate(heaps):
            if len(heap.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heap.scores), i, dtype=np.int32)), pa.array(heap.scores), pa.array(heap.ids, mask=heap.nulls)],
                    names=["item", "score", "doc_id"])
    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(term_counts(t or b"")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def search(index: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, window: int = WINDOW, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The ``k`` best documents of ``index`` for every row of ``items`` (item: its number from 0, terms: array of binary):
    (item, rank, doc_id, score).  Queries go to the index in blocks of ``item_block``, one pass each."""
    spark = index.sparkSession
    ship(spark)
    whole = index.filter(F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("total").alias("l")).first()
    n_docs, total = int(whole["n"] or 0), int(whole["l"] or 0)
    n_items = items.agg(F.max("item")).first()[0]
    out = spark.createDataFrame([], "item long, score long, doc_id long")
    for at in range(0, 0 if n_items is None or not n_docs else n_items + 1, item_block):
        asked = {r["item"]: [bytes(t) for t in r["terms"]] for r in items.filter(F.col("item").between(at, at + item_block - 1)).collect()}
        terms = spark.createDataFrame([(t,) for t in sorted({t for x in asked.values() for t in x})], "term binary")
        dfs = index.filter(F.col("term").isNotNull()).select("term", "n").join(F.broadcast(terms), "term", "left_semi")
        weights = {bytes(r["term"]): weight(n_docs, r["df"]) for r in dfs.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        numbers = sorted(asked)
        job = spark.sparkContext.broadcast((n_docs, total, [asked[i] for i in numbers], weights))
        needed = index.join(F.broadcast(terms.withColumnRenamed("term", "_term")), F.col("term") == F.col("_term"), "left")
        needed = needed.filter(F.col("term").isNull() | F.col("_term").isNotNull()).select(*_INDEX.names)
        found = needed.mapInArrow(_searched(job, k, block, window), "item int, score long, doc_id long")
        place = spark.createDataFrame(list(enumerate(numbers)), "_place int, _item long")
        found = found.join(F.broadcast(place), F.col("item") == F.col("_place")).select(F.col("_item").alias("item"), "score", "doc_id")
        out = out.union(found)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", query_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """The ``k`` highest-scoring documents of every row of ``queries``: item id, rank (from 1), document id, score.

    Equal scores go by ascending document id, a null id last; rows that repeat an id are documents of their own.
    Each row of ``queries`` is a query of its own, a null or empty text finds nothing.  Null texts and texts without a
    term never rank and are not counted.  Other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    asked = queries.select(F.col(item_col).alias("_id"), F.col(query_col).cast("string").cast("binary").alias("_text"))
    name = fresh(asked, "_n")
    numbered, _ = global_index(cut(asked), ["_id", "_text"], name)
    numbered = cut(numbered)
    items = cut(numbered.select(F.col(name).alias("item"), "_text").mapInArrow(_terms, "item long, terms array<binary>"))
    distinct = items.select(F.explode("terms").alias("term")).distinct()
    few = distinct.count() <= vocabulary
    index = build_index(docs, {bytes(r["term"]) for r in distinct.collect()} if few else None, id_col, text_col)
    found = search(index, items, k)
    return found.join(numbered.select(F.col(name).alias("item"), "_id"), "item").select(
        F.col("_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
