"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import ensure_checkpoint_dir
from trawl.session import ship_code as ship  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, kept if executors go."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, key: Column, expected: int, total: int, salt: int = 0) -> DataFrame:
    """About ``expected`` of ``total`` rows, chosen by a hash of ``key``: the same rows on every
    run, without a sort or a shuffle.  All rows if there are no more than ``expected``."""
    if total <= expected:
        return df
    steps = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(steps)) < F.lit(int(steps * expected / total)))


def train_sample(docs: DataFrame, labels: DataFrame, label: str, expected: int, salt: int = 0) -> DataFrame:
    """(id, text, label) of about ``expected`` labelled documents that are not held out.  ``docs`` has doc_id and text,
    ``labels`` has doc_id and the column ``label`` of 0 and 1; of several labels of one id the largest counts.
    The chosen labels go to every executor: there are about ``expected`` of them at most."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = hash_sample(marks, F.col("id"), expected, marks.count(), salt)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("id", "text", "label")


def global_index(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``out`` = 0-based place of the row in the order of the columns ``order``, and the row
    count.  Ranges of the order go to separate tasks, so no task sees all rows; the driver gets one
    count per range.  Equal rows are spread over ranges by their place in the input, so a value that
    a third of the rows share does not meet in one task.  ``df`` is read twice: cut it if it is dear."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, pos = fresh(df, "_tie"), fresh(df, "_pos")
    ranged = cut(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(n, *order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .withColumn(pos, F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col(pos), _LOCAL_BITS)
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())
    base, bases = 0, []
    for p, c in counts:
        bases.append((p, base))
        base += c
    offsets = spark.createDataFrame(bases or [(0, 0)], "_range_id long, _range_base long")  # one row per range
    indexed = ranged.join(F.broadcast(offsets), part == F.col("_range_id"))
    local = F.col(pos).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return indexed.withColumn(out, F.col("_range_base") + local).drop(pos, "_range_id", "_range_base"), base
