"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Rows are numbered in a fixed order, the number goes through a Feistel permutation of [0, n) with
cycle walking, and shard and slot follow from the permuted number by division: anyone who knows
n, the seed and the row number can compute them without reading the table.

The network works on numbers written as (left, right) with left < a, right < b and a * b just
above n, so that few numbers fall outside [0, n); those walk on until they are inside.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import fresh, global_index

ROUNDS = 6
WALKS = 12  # a walk goes on with probability about 1 / sqrt(n); one not ended by then is an error
PRIME = (1 << 31) - 1


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below 2**30 for each round."""
    digests = [hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(rounds)]
    return [(int.from_bytes(d[:4], "big") >> 2, int.from_bytes(d[4:8], "big") >> 2) for d in digests]


def permute_py(x: int, n: int, seed: int) -> int:
    """The same permutation for one number: what a reader needs to find a row's shard and slot."""
    a, b = radices(n)
    while True:
        left, right = divmod(x, b)
        for i, (k1, k2) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + (right % PRIME + k1) % PRIME * ((right % PRIME + k2) % PRIME) % PRIME) % a
            else:
                right = (right + (left % PRIME + k1) % PRIME * ((left % PRIME + k2) % PRIME) % PRIME) % b
        x = left * b + right
        if x < n:
            return x


def permute(x: Column, n: int, seed: int) -> Column:
    """Permuted ``x`` (0 <= x < n) as one expression."""
    a, b = radices(n)
    keys = F.array(*[
        F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(k1).cast("long").alias("k1"), F.lit(k2).cast("long").alias("k2"))
        for i, (k1, k2) in enumerate(round_keys(seed))
    ])

    def mix(v: Column, k: Column) -> Column:
        return ((v % PRIME + k["k1"]) % PRIME * ((v % PRIME + k["k2"]) % PRIME)) % PRIME

    def step(s: Column, k: Column) -> Column:
        return F.struct(
            F.when(k["even"], (s["l"] + mix(s["r"], k)) % a).otherwise(s["l"]).alias("l"),
            F.when(k["even"], s["r"]).otherwise((s["r"] + mix(s["l"], k)) % b).alias("r"),
        )

    def network(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b)).alias("l"), (v % b).cast("long").alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    def walk(s: Column, i: Column) -> Column:
        return F.when((i > 0) & (s < n), s).otherwise(network(s))

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), x.cast("long"), walk)
    return F.transform(
        F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    )[0]


def shard_documents(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size (UTF-8 bytes of the text + 16), text_crc32, row_number
    (0-based, in order of id, checksum and size), place (the permuted number), shard = place mod
    ``shards`` and slot = place div ``shards``.  Shard counts are at most one apart and slots have no gaps.

    Nulls: a null text has no bytes and checksum 0; null ids come first.  Rows that are equal in id,
    checksum and size get neighbouring numbers, in any order among themselves.  An empty table gives an
    empty table.  Other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = global_index(rows, ["doc_id", "text_crc32", "size"], "row_number")
    placed = numbered.withColumn("place", permute(F.col("row_number"), max(n, 1), seed))
    out = placed.select(
        "doc_id", "size", "text_crc32", "row_number", "place",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {int(shards)}").cast("long").alias("slot"),
    )
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", fresh(out.drop("doc_id"), id_col))
