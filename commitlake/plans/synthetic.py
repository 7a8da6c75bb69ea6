"""A commit log derived from the ``events`` table, so that graph operators run on data any SQL engine can rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W


def synthetic_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event: keyed by user, every fifth forks, every eleventh merges, every seventeenth deletes."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    w = W.partitionBy("user_id").orderBy("event_id")
    rn, p1, p2 = F.row_number().over(w), F.lag("event_id", 1).over(w), F.lag("event_id", 2).over(w)
    base = ev.select("*", rn.alias("rn"), p1.alias("p1"), p2.alias("p2"))
    full = F.when(F.col("rn") % 3 == 0, F.col("event_id"))
    base = base.withColumn("base", F.last(full, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    parents = F.when(F.col("rn") == 1, F.array().cast("array<bigint>")).when(F.col("rn") % 11 == 0, F.array("p1", "p2")).when(F.col("rn") % 5 == 0, F.array("p2")).otherwise(F.array("p1"))
    return base.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("connection"), (F.col("user_id") % 7).alias("session"),
        "ts", (F.col("event_id") + 1).alias("age"), "rn", parents.alias("parents"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_type", (F.col("rn") % 17 == 0).alias("is_deleted"), (F.lit(1) + F.col("event_id") % 2).cast("int").alias("scheme_version"),
        F.when(F.col("rn") % 3 != 0, F.col("base")).alias("base"),
    )
