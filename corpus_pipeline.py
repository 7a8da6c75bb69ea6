"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing by source, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
``documents``; the last one adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlake.llm.common import scratch_path, table
from commitlake.llm.decontam import drop_contaminated
from commitlake.llm.mixing import mix_documents
from commitlake.llm.sharding import shard_documents
from commitlake.llm.simhash import near_dedup
from commitlake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, and repeated, to the target of their source."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are shuffled into 24 shards of equal size."""
    return shard_documents(docs, 24)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None  # the classifier, the fingerprints and the draw have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
