"""A corpus pipeline of the training-data operators: quality rules, toxicity, near copies, benchmark
decontamination, packing.  Each stage gets what its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import decontam, packing, quality, simhash, toxicity
from trawl.llm.common import cut, table
from trawl.llm.queries import tokenizer_path
from trawl.session import ensure_checkpoint_dir
from trawl.sources.files import remove_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject: texts of under 20 words (null and empty ones too), of repeated windows, or of mostly
    boilerplate lines.

    Repeated rows are rows of their own but for the near copies; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; null and empty texts stay.

    Repeated rows are rows of their own but for the near copies; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest id, a null id last.  Null and wordless texts are one group.

    Repeated rows are rows of their own but for the near copies; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate; null and wordless texts stay.

    Repeated rows are rows of their own but for the near copies; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences; a null text is an empty one.

    Repeated rows are rows of their own but for the near copies; an empty table gives an empty one; other columns, whatever
    their names, are not read."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Trained models, XXH64 fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again.  The last one is cut
    there too, so that the stages' files can go.  An empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove_folder(spark, place)
    return packed
