"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors lie in shards of bounded size.  A shard holds, for every dimension, its vectors in the order
of that component.  A query walks all lists in step, from the top where its own component is positive
and from the bottom where it is negative.  Every vector met is scored in full, and the scores
of the components at the present depth add up to a bound for all vectors not met yet: once that
is below the k-th best score so far, the rest of the shard is left alone.  A task carries the
k-th scores from shard to shard, so later shards stop earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut, global_index, ship

SHARD = 4096  # vectors of a shard
QUERY_BLOCK = 2048  # queries of one pass over the shards
DEPTHS = 64  # a round goes 1/64, 1/32, ... of a shard deep
_LONG = (1 << 63) - 1
_INDEX = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("rows", pa.binary()),
                    ("values", pa.binary()), ("wide", pa.bool_()), ("lists", pa.binary())])
_INDEX_DDL = "n int, dims int, ids binary, nulls binary, rows binary, values binary, wide boolean, lists binary"


def usable(vector: Column, scale: int) -> Column:
    """True for vectors of which every component times ``scale`` is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf")))), F.lit(False))


def whole(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, vector) with components floor(scale * x); vectors that are not ``usable`` are left out.  ``row`` tells
    rows of equal ids apart."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    x = cut(x.filter(usable(F.col("x"), scale)).withColumn("row", F.monotonically_increasing_id()))
    # as double: a floor cast to long would fail beyond its range
    floors = F.transform("x", lambda v: F.when(F.abs(v * scale) < F.lit(2.0**52), F.floor(v * scale).cast("double")).otherwise(v * scale))
    return x.select("row", "id", floors.alias("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """One row per vector; a shorter vector is filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _shards(size: int):
    def rows(ids, numbers, parts) -> pa.RecordBatch:
        dims = max(p.shape[1] for p in parts)
        x = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
        wide = bool(np.abs(x).max(initial=0) > 32767)
        lists = np.argsort(x, axis=0, kind="stable").T.astype("<i4")
        row = {"n": len(x), "dims": dims, "ids": np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(),
               "nulls": np.array([i is None for i in ids], dtype=np.uint8).tobytes(), "rows": np.array(numbers, dtype=np.int64).tobytes(),
               "values": (x if wide else x.astype("<i2")).tobytes(), "wide": wide, "lists": lists.tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _INDEX], schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, parts = [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if ids and len(ids) + part.num_rows > size:
                    yield rows(ids, numbers, parts)
                    ids, numbers, parts = [], [], []
                numbers += part.column(0).to_pylist()
                ids += part.column(1).to_pylist()
                parts.append(_matrix(part.column(2)))
        if ids:
            yield rows(ids, numbers, parts)
    return run


def build_lists(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """The sorted per-dimension lists of ``vectors`` (row, id, vector), one row per shard of up to ``shard`` vectors, written
    to the shared checkpoint folder."""
    ship(vectors.sparkSession)
    return cut(vectors.select("row", "id", "vector").mapInArrow(_shards(shard), _INDEX_DDL))


class Best:
    """The k best of one query: scores, ties by id (null last), then by row."""

    def __init__(self, k: int):
        self.k, self.kth = k, -np.inf
        self.scores = np.zeros(0)
        self.nulls, self.ids, self.rows = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def put(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        near = scores >= self.kth
        if not near.any():
            return
        s, n, i, r = (np.concatenate((a, b[near])) for a, b in ((self.scores, scores), (self.nulls, nulls), (self.ids, ids), (self.rows, rows)))
        if s.dtype == object:
            order = np.array(sorted(range(len(s)), key=lambda j: (-s[j], n[j], i[j], r[j]))[: self.k])
        else:
            order = np.lexsort((r, i, n, -s))[: self.k]
        self.scores, self.nulls, self.ids, self.rows = s[order], n[order], i[order], r[order]
        if len(order) == self.k:
            self.kth = self.scores[-1]


def threshold_search(query: np.ndarray, own: int, x: np.ndarray, lists: np.ndarray, nulls, ids, rows, best: Best, depths: list[int]) -> int:
    """The threshold algorithm of one query over one shard; ``own`` is the place of the query's own row, -1 if it is
    elsewhere.  Returns how deep it went."""
    n = len(x)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, dtype=bool)
    if own >= 0:
        seen[own] = True
    done = 0
    for depth in depths:
        if len(up) + len(down):
            # The components that the lists show next bound every vector not met so far.
            bound = query[up] @ x[lists[up, n - 1 - done], up] + query[down] @ x[lists[down, done], down]
            if bound < best.kth:
                return done
            met = np.zeros(n, dtype=bool)
            met[lists[up, n - depth : n - done]] = True
            met[lists[down, done:depth]] = True
            new = np.flatnonzero(met & ~seen)
        else:  # a query of zeros scores 0 with every vector
            if best.kth > 0:
                return done
            new = np.flatnonzero(~seen)
        seen[new] = True
        if len(new):
            best.put(x[new] @ query, nulls[new], ids[new], rows[new])
        done = depth
        if seen.all():
            break
    return done


def _searched(job, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, numbers = job.value
        best = [Best(k) for _ in numbers]
        order = np.argsort(numbers)
        for batch in batches:
            for shard in batch.to_pylist():
                n, dims = shard["n"], shard["dims"]
                x = np.frombuffer(shard["values"], "<f8" if shard["wide"] else "<i2").reshape(n, dims).astype(float)
                lists = np.frombuffer(shard["lists"], "<i4").reshape(dims, n)
                ids, rows = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["rows"], np.int64)
                nulls = np.frombuffer(shard["nulls"], np.uint8).astype(bool)
                q = np.pad(asked, ((0, 0), (0, max(0, dims - asked.shape[1]))))[:, :dims]
                # Doubles hold every sum exactly up to 2^53; beyond that whole numbers of any size do.
                if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * dims >= 2.0**53:
                    x = np.array([[int(v) for v in r] for r in x], dtype=object).reshape(n, dims)
                    q = np.array([[int(v) for v in r] for r in q], dtype=object).reshape(len(q), dims)
                own = np.full(len(numbers), -1)
                at = np.minimum(np.searchsorted(numbers[order], rows), len(order) - 1)
                mine = numbers[order][at] == rows
                own[order[at[mine]]] = np.flatnonzero(mine)
                steps = [d for i in range(6, -1, -1) if (d := n >> i)]
                for j in range(len(numbers)):
                    threshold_search(q[j], own[j], x, lists, nulls, ids, rows, best[j], steps)
        for j, b in enumerate(best):
            if len(b.scores):
                scores = [max(-_LONG - 1, min(_LONG, int(s))) for s in b.scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), numbers[j])), pa.array(scores, pa.int64()), pa.array(b.ids, mask=b.nulls), pa.array(b.rows)],
                    names=["query", "score", "id", "row"])
    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` other rows with the largest inner product of the vectors
    floor(scale * x): query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id, a null id comes last, rows of equal ids by their place in the table.  Vectors that are
    null or have null or non-finite components (also after scaling) take no part; a shorter vector counts as filled up
    with zeros; a score beyond a long is cut to its range.  A row is told from its copies by its place, so a
    repeated row of a query is a candidate.  Other columns are not read; an empty table gives no rows.
    Queries go to the shards in blocks of ``query_block``, one pass each."""
    spark = vectors.sparkSession
    rows = cut(whole(vectors, scale, id_col, vector_col))
    index = build_lists(rows, shard)
    asked, n = global_index(rows.filter(F.col("id") % every == 0), ["id", "row"], "number")
    asked = cut(asked)
    out = spark.createDataFrame([], "query long, score long, id long, row long")
    for at in range(0, n, query_block):
        block = asked.filter(F.col("number").between(at, at + query_block - 1)).collect()
        dims = max(len(r["vector"]) for r in block)
        q = np.array([r["vector"] + [0.0] * (dims - len(r["vector"])) for r in block]).reshape(len(block), dims)
        job = spark.sparkContext.broadcast((q, np.array([r["row"] for r in block], dtype=np.int64)))
        out = out.union(index.mapInArrow(_searched(job, k), "query long, score long, id long, row long"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    top = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
