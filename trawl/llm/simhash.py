"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint is four 16-bit segments.  Segments are decoded with the binary Golay code (23, 12):
the keys of a segment are the codewords within distance 4 of it, one or six of them, and two
segments that differ in at most 2 bits always share a key.  With at most 4 differing bits in the
whole fingerprint the pigeonhole leaves three cases:

* two segments agree: six exact keys, one per pair of segments;
* exactly one segment agrees: the other three hold at least one error each and so at most 2:
  the exact segment with the Golay keys of the segment after it;
* every segment has exactly one error: then one of the two bytes of segment 0 agrees, and one of
  segment 1: the four pairs of bytes with the Golay keys of segment 2.

Fingerprints that share a key are compared in full.  Within a key only a spanning forest of the
links is kept, so a key with many near copies yields no more rows than it has fingerprints, and a
key with more fingerprints than ``BLOCK`` is dealt out as pairs of blocks to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, fresh, ship
from trawl.llm.components import components

MAX_BITS = 4  # what the three cases above cover
BLOCK = 4096  # fingerprints of one key compared by one task at a time
SEND_ROWS = 100_000  # a longer list of large keys is joined by a shuffle instead of a broadcast
SEED = 42
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority of the XXH64 bits of all word shingles, as an unsigned number; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    last = max(1, len(words) - shingle + 1)
    for at in range(0, last, 1 << 16):  # long texts a stretch at a time
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(last, at + (1 << 16)))],
            dtype=">u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(texts: pd.Series, shingle: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t, int(n)) for t, n in zip(texts, shingle, strict=True)], dtype="uint64").astype("int64")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@lru_cache(maxsize=1)
def golay_keys() -> np.ndarray:
    """For each 16-bit value, the 12-bit indices of the codewords within distance 4 (-1: none), 65536 x 6.

    The value is read as a 23-bit word with seven zeros in front.  The code is perfect: each word is
    within 3 of one codeword.  If that distance is 3, five codewords more are at distance 4: those that
    differ from the first in seven places which take in the three errors."""
    data = np.arange(1 << 12, dtype=np.int64)
    code = data << 11
    rest = code.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    code = code | rest  # systematic: data, then the remainder

    def syndrome(v: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
        return v

    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], dtype=np.int64)
    leader = np.zeros(1 << 11, dtype=np.int64)
    leader[syndrome(errors)] = errors
    values = np.arange(1 << 16, dtype=np.int64)
    error = leader[syndrome(values)]
    nearest = values ^ error
    keys = np.full((1 << 16, 6), -1, dtype=np.int64)
    keys[:, 0] = nearest >> 11
    seven = code[_popcount(code) == 7]
    far = np.flatnonzero(_popcount(error) == 3)
    for i in range(0, len(far), 4096):
        rows = far[i : i + 4096]
        over = (error[rows, None] & seven[None, :]) == error[rows, None]
        at = np.nonzero(over)[1].reshape(len(rows), 5)
        keys[rows, 1:] = (nearest[rows, None] ^ seven[at]) >> 11
    return keys


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fps``, key) for all keys of unsigned fingerprints.  A key's high bits name its case."""
    fps = fps.astype(np.uint64)
    seg = [((fps >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    golay, rows = golay_keys(), np.arange(len(fps))
    at, out, case = [], [], 0

    def put(exact: np.ndarray, fuzzy: np.ndarray | None) -> None:
        nonlocal case
        if fuzzy is None:
            at.append(rows)
            out.append((case << 40) | exact)
        else:
            near = golay[fuzzy]
            r, c = np.nonzero(near >= 0)
            at.append(rows[r])
            out.append((case << 40) | (exact[r] << 12) | near[r, c])
        case += 1

    for i, j in combinations(range(4), 2):
        put((seg[i] << 16) | seg[j], None)
    for i in range(4):
        put(seg[i], seg[(i + 1) % 4])
    for i in (8, 0):
        for j in (8, 0):
            put((((seg[0] >> i) & 255) << 8) | ((seg[1] >> j) & 255), seg[2])
    return np.concatenate(at), np.concatenate(out)


def _key_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 1 << 13):
            part = fps[i : i + (1 << 13)]
            at, keys = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], names=["key", "fp"])


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``max_bits`` differing bits) among distinct fingerprints, by
    a search that compares each one with those not reached yet."""
    left, edges = np.asarray(fps, dtype=np.int64).view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _popcount(left ^ one) <= max_bits
            if near.any():
                found = left[near]
                edges.extend((int(np.int64(one.view(np.int64))), int(x)) for x in found.view(np.int64))
                queue.extend(found)
                left = left[~near]
    return edges


def _links(max_bits: int):
    """Reads rows (group, fp) sorted by group, one group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(group):
                continue
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(starts[1:], len(group))
            edges: list[tuple[int, int]] = []
            if held_group is not None and group[0] == held_group:
                held = np.concatenate((held, fps[: ends[0]]))
                first = 1
            else:
                first = 0
            if first < len(starts):  # the held group has ended
                if len(held) > 1:
                    edges += forest(np.unique(held), max_bits)
                wide = np.flatnonzero(ends - starts > 1)
                for k in wide[(wide >= first) & (wide < len(starts) - 1)]:
                    edges += forest(np.unique(fps[starts[k] : ends[k]]), max_bits)
                held_group, held = group[starts[-1]], fps[starts[-1] :].copy()
            if edges:
                a, b = np.array(edges, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if len(held) > 1:
            edges = forest(np.unique(held), max_bits)
            if edges:
                a, b = np.array(edges, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fps`` (fp: long) which chains of steps of at
    most ``max_bits`` bits connect; near groups get a spanning forest per key, not all their pairs."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    ship(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(_key_table, "key long, fp long")
    sizes = keyed.groupBy("key").count()
    large = cut(sizes.filter(F.col("count") > block).select(
        F.col("key").alias("large_key"), F.ceil(F.col("count") / block).cast("int").alias("blocks")
    ))
    send = F.broadcast if large.count() <= SEND_ROWS else (lambda df: df)
    spread = keyed.join(send(large), F.col("key") == F.col("large_key"), "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = spread.withColumn("mine", mine).select("key", "fp", "mine", other.alias("other")).select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "fp"
    )
    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_links(max_bits), "a long, b long")


def _clusters(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, least, root) of every distinct fingerprint."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    prints = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.pandas_udf(_fingerprints, "long").asNondeterministic()(text, F.lit(shingle)).alias("fp"),
    ))
    by_fp = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(by_fp, max_bits, block))
    return prints, by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id that can be
    reached over links of at most ``max_bits`` differing bits.

    A null text and a text without words have fingerprint zero and link like any other; equal
    fingerprints always link.  Null ids are never a component's id unless it has no other; repeated
    rows each get their row; an empty table gives an empty table; other columns are not read.
    Words are cut at ASCII white space after A-Z are lower-cased; whole texts are read.
    """
    prints, classes = _clusters(docs, shingle, max_bits, id_col, text_col, block)
    # Both cut: two freshly shuffled sides let Spark split a component that holds a large share of all fingerprints.
    classes = cut(classes)
    of_root = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    label = classes.join(of_root, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK) -> DataFrame:
    """One row of each group of near copies, columns unchanged: the one with the smallest id (a null id comes
    last), then the smallest text hash; of rows equal in both, any one."""
    prints, classes = _clusters(docs, shingle, max_bits, id_col, text_col, block)
    # Dealt out anew before the cut: two freshly shuffled sides let Spark split a fingerprint that many rows share.
    classes = cut(classes.select("fp", "root").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = prints.groupBy("doc_id", "text_hash", "fp").count().join(classes, "fp")
    rows = cut(rows.select("root", "doc_id", "text_hash", "count"))
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")
    heads = rows.groupBy("root").agg(F.min(order).alias("head")).select(
        F.col("head.doc_id").alias("_head_id"), F.col("head.text_hash").alias("_head_hash"))
    # Rows meet their heads by the row and not by the group, which may hold a third of all rows.
    is_head = [F.col("doc_id").eqNullSafe(F.col("_head_id")), F.col("text_hash").eqNullSafe(F.col("_head_hash"))]
    judged = rows.join(heads.withColumn("_first", F.lit(True)), on=is_head, how="left").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.coalesce("_first", F.lit(False)).alias("_first"),
        F.col("count").alias("_count"))
    judged = cut(judged.filter(~F.col("_first") | (F.col("_count") > 1)))
    h = fresh(docs, "_text_hash")
    hashed = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))

    def match(keys: DataFrame) -> list[Column]:
        return [hashed[id_col].eqNullSafe(keys["_id"]), hashed[h] == keys["_hash"]]

    kept = hashed.join(judged, on=match(judged), how="left_anti").drop(h)
    again = judged.filter(F.col("_first"))
    repeated = hashed.join(again, on=match(again), how="left_semi").groupBy(id_col, h).agg(
        F.any_value(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")
    )
    return kept.unionByName(repeated.select("_row.*"))
