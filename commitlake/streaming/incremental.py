"""Structured Streaming over a commit log: heads and query results kept as tables, one generation per micro-batch.

A generation is named by its batch id and complete when its _SUCCESS file is there: a batch that is repeated after a
failure starts from the one before its own and writes the same again, so results are exactly once.  Generations older
than the last two are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import newest_per
from ..operators.query import Query, result_delta
from ..sources.log import parse_commits


def read_commits(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Commits of a growing folder of JSON lines; malformed lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    named = lines.select(F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), "value")
    return parse_commits(named)


def deduplicated(commits: DataFrame, delay: str = "30 days") -> DataFrame:
    """At-least-once input to once each; the watermark bounds only the state of this step."""
    return commits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


class Generations:
    """Tables ``path/g=<batch id>``, each the whole state after a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self) -> list[int]:
        """Batch ids whose writer has left its mark, in order."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(at):
            return []
        found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("g=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self, before: int | None = None) -> DataFrame | None:
        """The newest generation, or the newest before a batch."""
        done = [g for g in self.complete() if before is None or g < before]
        return self.spark.read.parquet(f"{self.path}/g={done[-1]}") if done else None

    def store(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/g={batch_id}")
        jvm, fs = self._fs()
        for g in [g for g in self.complete() if g < batch_id][:-1]:  # a repeated batch needs the one before it
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/g={g}"), True)


class HeadTable(Generations):
    """Open leaves after each batch; a late commit is another leaf, so lateness never changes what is right.

    Beside open leaves the state holds, without their contents, commits that have been named as parents and names whose
    commits have not come: a repeated commit must not open again, and a parent may come after its child.  Both are kept
    for ``keep`` of event time, which bounds the state by the open leaves and what happened within it.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "30 days"):
        super().__init__(spark, path)
        self.keep = keep

    def heads(self) -> DataFrame:
        return newest_per(self.state().where("not _named"), "key")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        old = self.state(batch_id)
        fresh = batch.dropDuplicates(["id"]).withColumns({"_named": F.lit(False), "_seen": F.col("ts")})
        others = [c for c in fresh.columns if c not in ("id", "key", "_named", "_seen")]
        named = batch.select(F.explode("parents").alias("id"), "key", F.col("ts").alias("_seen"))
        empty = [F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in others]
        rows = fresh.unionByName(named.select("id", "key", "_seen", F.lit(True).alias("_named"), *empty))
        rows = rows if old is None else old.unionByName(rows)
        contents = F.max_by(F.struct(*others), F.when(F.col("ts").isNotNull(), 1).otherwise(0)).alias("_c")
        one = rows.groupBy("id").agg(F.first("key", ignorenulls=True).alias("key"), contents, F.bool_or("_named").alias("_named"), F.max("_seen").alias("_seen"))
        shown = [F.when(~F.col("_named"), F.col(f"_c.{c}")).alias(c) for c in others]
        newest = rows.agg(F.max("_seen")).first()[0]
        old_enough = F.col("_named") & (F.col("_seen") < F.lit(newest) - F.expr(f"interval {self.keep}"))
        self.store(one.where(~F.coalesce(old_enough, F.lit(False))).select("id", "key", "_named", "_seen", *shown), batch_id)


class ResultTable(Generations):
    """Keys of a query's result after each batch: only keys that the batch touched are tested again."""

    def __init__(self, spark: SparkSession, path: str, **config):
        super().__init__(spark, path)
        self.config = config  # scheme, predicate and ctx of the query

    def update(self, heads: DataFrame, touched: DataFrame, batch_id: int) -> DataFrame:
        """Returns (key, change), the keys that entered or left the result."""
        keys = touched.select("key").distinct()
        now = Query(heads.join(keys, "key", "left_semi"), **self.config).keys()
        old = self.state(batch_id)
        self.store(now if old is None else old.join(keys, "key", "left_anti").unionByName(now), batch_id)
        mark = lambda df: df.withColumn("_v", F.lit(1))
        return result_delta(mark(now.limit(0) if old is None else old), mark(self.state()), "_v")


def maintain_heads(commits: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start keeping heads; ``on_change`` gets (heads, batch id) after each micro-batch."""
    state = HeadTable(commits.sparkSession, path)

    def step(batch: DataFrame, batch_id: int) -> None:
        state.update(batch, batch_id)
        if on_change is not None:
            on_change(state.heads(), batch_id)

    return commits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(query: Query, previous: DataFrame, value: str = "id") -> DataFrame:
    """(key, change): what a subscriber sees between a result kept earlier and the present one."""
    return result_delta(previous, query.members(), value)


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Counts of each kind of event in tumbling windows, late events accepted up to ``delay``."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"))
