"""Statistics of all nodes of the prefix trie of conversations, by a splitter skeleton.

A conversation is the sequence of its turns, and a node of the trie is a distinct sequence of first
turns.  Turns become 16-byte digests, a conversation one binary path, and the paths are range
partitioned and sorted, so that a node's members are neighbours.  Two shards share exactly the
nodes above the common part of the paths at their border.  These splitter paths form a small trie,
the skeleton, which goes to every task:

* a node off the skeleton lies within one shard, which finishes it in one sorted pass with a stack;
* a node on the skeleton gets one partial aggregate from each shard that holds members, and the
  partials are reduced and summed up along the skeleton.

Equal paths are spread over shards by id, so a conversation that a third of all rows repeat needs no
special case: its path is on the skeleton.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import cut, ship

DIGEST = 16  # bytes of a turn in a path
FLUSH_ROWS = 20_000  # finished nodes sent on together
CHUNK = 1 << 16  # characters of ids sent on together
NODE, PARTIAL, ENDS = 0, 1, 2
_NO_ENDS = sha256(b"").hexdigest()
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_ROWS = pa.schema([("kind", pa.int32()), ("skel", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int32()),
                   *((c, pa.int64()) for c in _COLUMNS), ("length", pa.int64()), ("ends", pa.string())])
_ROWS_DDL = "kind int, skel int, shard int, chunk int, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", length long, ends string"


def turn_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (digest, length)) of every conversation, turns in order: a null turn number first,
    equal numbers by digest.  A null role or text is empty; rows without a conversation are left out.  Texts are
    digested before the shuffle, so a conversation costs about 50 bytes a turn there and in its row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), said.alias("digest"), F.char_length(text).alias("length")).alias("t"))
    in_order = F.array_sort(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["digest"], t["length"])).alias("turns"))


def rebuild(paths: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of the conversation c - c % ``group`` (all it has,
    none if it is not there), h = crc32 of c in decimal, modulo ``heads``.  The remainder has the sign of c."""
    first = F.slice("turns", 1, max(heads - 1, 1))
    of = paths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), first.alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = paths.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", h)
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", none), F.lit(1), F.greatest("_h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(of, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sorted_shards(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """(shard, conv_id, path, lengths): range partitions of the paths, sorted by path and then id."""
    n = partitions or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path")
    flat = paths.select("conv_id", path, F.transform("turns", lambda t: t["length"]).alias("lengths"))
    dealt = flat.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return cut(dealt.select(F.spark_partition_id().alias("shard"), "conv_id", "path", "lengths"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    n = min(len(a), len(b)) // DIGEST
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def skeleton(borders: list[tuple[int, bytes, bytes]]) -> tuple[dict[tuple[int, bytes], int], list[int]]:
    """The trie of the paths that neighbouring shards share, from (shard, first path, last path): (node, digest) to
    child, and each node's parent.  Node 0 is the root, and children come after their parents."""
    children: dict[tuple[int, bytes], int] = {}
    parents = [-1]
    last = None
    for _, low, high in sorted(borders):
        if last is not None:
            node = 0
            for d in range(common_turns(last, low)):
                key = (node, low[d * DIGEST : (d + 1) * DIGEST])
                if key not in children:
                    children[key] = len(parents)
                    parents.append(node)
                node = children[key]
        last = high
    return children, parents


class _Open:
    """A node whose members are being read."""

    __slots__ = ("depth", "digest", "length", "skel", "least", "n", "children", "leaves", "saved", "ends", "chunks", "rows")

    def __init__(self, depth: int, digest: bytes, length: int, skel: int | None):
        self.depth, self.digest, self.length, self.skel = depth, digest, length, skel
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = self.chunks = 0
        self.ends = None  # a running hash, or on the skeleton the ids not sent on yet
        self.rows: list[dict] = []  # finished children, which wait for the least member of this node


class _Shard:
    """One pass over the sorted paths of a shard."""

    def __init__(self, shard: int, children: dict[tuple[int, bytes], int]):
        self.shard, self.skeleton = shard, children
        self.stack = [_Open(0, b"", 0, 0)]
        self.out: list[dict] = []

    def add(self, conv: int, path: bytes, lengths: list[int]) -> None:
        keep = 1
        top = len(lengths) + 1
        while keep < min(len(self.stack), top) and self.stack[keep].digest == path[(keep - 1) * DIGEST : keep * DIGEST]:
            keep += 1
        while len(self.stack) > keep:
            self.close()
        for d in range(keep, top):
            digest = path[(d - 1) * DIGEST : d * DIGEST]
            above = self.stack[-1].skel
            self.stack.append(_Open(d, digest, lengths[d - 1], None if above is None else self.skeleton.get((above, digest))))
        node = self.stack[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.skel is None:
            if node.ends is None:
                node.ends = sha256(str(conv).encode())
            else:
                node.ends.update(b",%d" % conv)
        else:
            node.ends = node.ends or []
            node.ends.append(str(conv))
            if len(node.ends) * 8 > CHUNK:
                self.send_ends(node)

    def send_ends(self, node: _Open) -> None:
        if node.ends:
            self.out.append({"kind": ENDS, "skel": node.skel, "shard": self.shard, "chunk": node.chunks, "ends": ",".join(node.ends)})
            node.ends, node.chunks = [], node.chunks + 1

    def close(self) -> None:
        node = self.stack.pop()
        if node.skel is not None:
            self.send_ends(node)
            self.out.append({
                "kind": PARTIAL, "skel": node.skel, "shard": self.shard, "conv_id": node.least, "depth": node.depth, "n_convs": node.n,
                "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "length": node.length})
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.length
        row = {"kind": NODE, "conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.children,
               "n_leaves": leaves, "saved_tokens": saved, "ends": node.ends.hexdigest() if node.ends else _NO_ENDS}
        for child in node.rows:
            child["parent_conv_id"] = node.least
        self.out.extend(node.rows)
        up = self.stack[-1]
        up.n += node.n
        up.least = node.least if up.least is None else min(up.least, node.least)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.skel is None:
            up.rows.append(row)
        else:
            row["skel"] = up.skel
            self.out.append(row)

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ROWS], schema=_ROWS)


def _nodes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for shard, conv, path, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    now = _Shard(shard, shared.value)
                now.add(conv, path, lengths)
                if len(now.out) >= FLUSH_ROWS:
                    yield now.take()
        if now is not None:
            while now.stack:
                now.close()
            yield now.take()
    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (skel, shard, chunk, ends) in that order and hashes each skeleton node's ids as they come."""
    node, running = None, None
    def done():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([running.hexdigest()])], names=["skel", "ends_sha256"])
    for batch in batches:
        for skel, _, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if skel != node:
                if node is not None:
                    yield done()
                node, running = skel, sha256(ends.encode())
            else:
                running.update(b",")
                running.update(ends.encode())
    if node is not None:
        yield done()


def _reduce(spark: SparkSession, partials: DataFrame, parents: list[int]) -> DataFrame:
    """The finished skeleton nodes.  The driver holds no more rows than the skeleton has nodes, and it has made those."""
    summed = partials.groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("length").alias("length"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    nodes = {r["skel"]: r.asDict() for r in summed.collect()}
    for k in sorted(nodes, reverse=True):  # children before their parents
        x = nodes[k]
        x["n_leaves"] = x["n_leaves"] if x["n_children"] else 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["length"]
        if k:
            up = nodes[parents[k]]
            up["conv_id"] = x["conv_id"] if up["conv_id"] is None else min(up["conv_id"], x["conv_id"])
            for c, v in (("n_convs", x["n_convs"]), ("n_children", 1), ("n_leaves", x["n_leaves"]), ("saved_tokens", x["saved_tokens"])):
                up[c] += v
    rows = [(k, x["conv_id"], x["depth"], nodes[parents[k]]["conv_id"] if k else None, x["n_convs"], x["n_children"], x["n_leaves"],
             x["saved_tokens"]) for k, x in nodes.items()]
    return spark.createDataFrame(rows, "skel int, " + ", ".join(f"{c} long" for c in _COLUMNS))


def trie(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of ``paths`` (conv_id, turns), root included: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root.  No conversations give no rows.  The skeleton goes to every
    task: it has one node per turn that the paths at a border between two shards share, so its size is at
    most the number of shards times the turns of a conversation.  One conversation's path lies in one row."""
    spark = paths.sparkSession
    ship(spark)
    shards = sorted_shards(paths, partitions)
    borders = [tuple(r) for r in shards.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")).collect()]
    children, parents = skeleton([(s, bytes(a), bytes(b)) for s, a, b in borders])
    made = cut(shards.mapInArrow(_nodes(spark.sparkContext.broadcast(children)), _ROWS_DDL))
    top = _reduce(spark, made.filter(F.col("kind") == PARTIAL), parents)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = made.filter(F.col("kind") == ENDS).select("skel", "shard", "chunk", "ends")
    hashed = chunks.repartition(n, "skel").sortWithinPartitions("skel", "shard", "chunk").mapInArrow(_hash_ends, "skel int, ends_sha256 string")
    top = top.join(hashed, "skel", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    up = F.broadcast(top.select(F.col("skel").alias("_skel"), F.col("conv_id").alias("_up")))
    inner = made.filter(F.col("kind") == NODE).join(up, F.col("skel") == F.col("_skel"), "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).withColumnRenamed("ends", "ends_sha256")
    return inner.select(*_COLUMNS, "ends_sha256").union(top.select(*_COLUMNS, "ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 100, heads: int = 6, partitions: int | None = None,
                      **columns: str | Column) -> DataFrame:
    """The trie of all conversations after ``rebuild``.  Null texts, roles and turn numbers, repeated rows and ties are
    ordered as ``turn_paths`` says; other columns are not read; an empty table gives an empty table."""
    return trie(rebuild(turn_paths(conversations, **columns), group, heads), partitions)
