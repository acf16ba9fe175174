"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` are directed (a, b).  Every ``b`` beside ``a`` is hung on the least vertex of a's neighbourhood:
    those above ``a`` for the large star, those below for the small one."""
    near = pairs if large else pairs.filter("b < a")
    # Cut, so that both sides of the join are freshly shuffled and Spark can split a vertex with very many edges.
    least = cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    kept = near.filter("b > a") if large else near
    hung = kept.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node that can be reached.

    Large-star and small-star steps alternate until the edges no longer change; what is left is one
    star per component.  Minima are combined before the shuffle, so a node with very many edges costs
    one row per task, and each round is cut in the checkpoint folder.  Loops, repeated and reversed
    edges are allowed; an empty table gives an empty table."""
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    while True:
        stars = cut(_star(_both_ways(_star(_both_ways(now), True)), False))
        new = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark, now = tuple(new), stars
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
