"""Ordered statistics without a single-task window: running totals, global ranks, max-hit cuts,
and the roll-ups of a folder scan.

A window with ``orderBy`` and no ``partitionBy`` runs in one task.  Instead, rows are range-
partitioned on the ordering key, each range gets a subtotal (one row per range), the subtotals
become offsets (a table of as many rows as there are ranges — a fixed, small bound, so it is
broadcast), and a window *partitioned by range* finishes the job in parallel.  The ranged data
is checkpointed to the shared checkpoint folder so the range assignment is computed once and
stays identical across the jobs that read it, even if executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import ensure_checkpoint_dir


def _ranged(df: DataFrame, order_cols: Sequence[str], n_ranges: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order_cols).withColumn("_range", F.spark_partition_id()).checkpoint()


def running_sum(
    df: DataFrame,
    order_cols: Sequence[str],
    value_col: str,
    out_col: str = "running",
    inclusive: bool = False,
    n_ranges: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over all rows ordered before this one (plus this
    one when ``inclusive``).  ``order_cols`` must identify rows uniquely."""
    ranged = _ranged(df, order_cols, n_ranges)
    per_range = ranged.groupBy("_range").agg(F.sum(value_col).alias("_range_total"))
    offsets = per_range.select(
        "_range",
        F.coalesce(
            F.sum("_range_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(out_col, (F.col("_offset") + F.coalesce(F.sum(value_col).over(w), F.lit(0))).cast("long"))
        .drop("_range", "_offset")
    )


def global_rank(df: DataFrame, order_cols: Sequence[str], out_col: str = "rank", n_ranges: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order_cols`` (unique), computed in
    parallel."""
    ranged = _ranged(df, order_cols, n_ranges)
    per_range = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_offset"
        ),
    )
    w = Window.partitionBy("_range").orderBy(*order_cols)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(out_col, (F.col("_offset") + F.row_number().over(w)).cast("long"))
        .drop("_range", "_offset")
    )


def max_hits_cut(units: DataFrame, order_cols: Sequence[str], count_col: str, max_hits: int) -> DataFrame:
    """Keep the units (files, pages) processed before the running total reached ``max_hits``:
    the unit that reaches the limit is kept, so the total may overshoot.  0 disables the cut."""
    if max_hits <= 0:
        return units
    with_run = running_sum(units, order_cols, count_col, out_col="_before")
    return with_run.filter(F.col("_before") < F.lit(max_hits)).drop("_before")


def folder_stats(files: DataFrame, matches_per_file: DataFrame, max_bytes: int, id_col: str = "path",
                 length_col: str = "length", failed_col: str | None = None) -> DataFrame:
    """One-row run statistics: scanned (failed included), skipped by size, failed, with matches,
    total matches."""
    f = files.select(
        id_col,
        (F.col(length_col) > F.lit(max_bytes)).alias("_skipped"),
        (F.col(failed_col) if failed_col else F.lit(False)).alias("_failed"),
    )
    joined = f.join(matches_per_file.select(id_col, "total_matches"), id_col, "left")
    return joined.agg(
        F.count_if(~F.col("_skipped")).cast("long").alias("files_scanned"),
        F.count_if(F.col("_skipped")).cast("long").alias("files_skipped"),
        F.count_if(F.col("_failed") & ~F.col("_skipped")).cast("long").alias("files_failed"),
        F.count_if(F.coalesce(F.col("total_matches"), F.lit(0)) > 0).cast("long").alias("files_with_matches"),
        F.coalesce(F.sum("total_matches"), F.lit(0)).cast("long").alias("total_matches"),
    )
