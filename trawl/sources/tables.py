"""Corpus tables: the parquet tables a search runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.session import table_path

TABLES = (
    "documents", "pages", "conversations", "benchmark", "labels", "events",
)


SCAN_PARTITIONS = "spark.trawl.scan.partitions"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files split it.  Text search is CPU-bound per row, so for a corpus stored in fewer row
    groups than there are cores the caller can set ``spark.trawl.scan.partitions``: every table is then dealt
    to that many partitions after the scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations")
