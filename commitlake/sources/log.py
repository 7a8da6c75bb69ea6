"""Commit logs: one JSON object a line, blank lines allowed, malformed tails cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window as W

FIELDS = {"ver": "build_version", "id": "id", "k": "key", "s": "session", "ts": "ts_ms", "org": "org", "p": "parents", "af": "ancestors_filter", "ac": "ancestors_count", "sig": "signature", "mb": "merge_base", "ml": "merge_leader", "revert": "revert", "cid": "connection"}
RECORD = T.StructType([T.StructField("s", T.StringType()), T.StructField("d", T.StringType()), T.StructField("n", T.BooleanType()), T.StructField("cs", T.StringType())])
EDIT = T.StructType([T.StructField("sc", T.StringType()), T.StructField("dc", T.StringType()), T.StructField("c", T.StringType()), T.StructField("s", T.StringType())])
SCHEMA = T.StructType([
    T.StructField("ver", T.LongType()), T.StructField("id", T.StringType()), T.StructField("k", T.StringType()), T.StructField("s", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("org", T.StringType()),
    T.StructField("p", T.ArrayType(T.StringType())), T.StructField("af", T.StringType()), T.StructField("ac", T.IntegerType()),
    T.StructField("c", T.StructType([T.StructField("r", RECORD), T.StructField("b", T.StringType()), T.StructField("e", EDIT)])),
    T.StructField("sig", T.StringType()), T.StructField("mb", T.StringType()), T.StructField("ml", T.StringType()), T.StructField("revert", T.StringType()), T.StructField("cid", T.StringType()),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): lines in an order that follows files, blocks and lines."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")


def valid_prefix(lines: DataFrame) -> DataFrame:
    """Lines of each file before its first malformed one."""
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull())
    bad = parsed.where("not ok").groupBy("file").agg(F.min(F.struct("block", "line")).alias("bad"))
    kept = parsed.join(bad, "file", "left")
    return kept.where(F.col("bad").isNull() | (F.struct("block", "line") < F.col("bad"))).drop("ok", "bad")


def parse_commits(lines: DataFrame) -> DataFrame:
    """Typed commit columns; a full commit has payload and scheme, a delta has base and edit."""
    c = lines.withColumn("j", F.from_json("value", SCHEMA)).where("j is not null")
    flat = [F.col(f"j.{short}").alias(name) for short, name in FIELDS.items() if short != "p"]
    marker = F.coalesce("j.c.r.s", "j.c.e.s")
    return c.select(
        *flat, F.coalesce("j.p", F.array().cast("array<string>")).alias("parents"), F.timestamp_millis("j.ts").alias("ts"),
        F.col("j.c.r.d").alias("payload"), F.coalesce("j.c.r.cs", "j.c.e.dc").alias("checksum"), F.col("j.c.b").alias("base"), F.col("j.c.e.c").alias("edit"), F.col("j.c.e.sc").alias("source_checksum"),
        F.split_part(marker, F.lit("/"), F.lit(1)).alias("scheme_ns"), F.expr("try_cast(split_part(coalesce(j.c.r.s, j.c.e.s), '/', 2) as int)").alias("scheme_version"), "file", "block", "line",
    )


def dedupe_with_age(commits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First occurrence of each id; ``age`` counts up in log order.

    Ages need one global order: ids are first reduced, then only (id, position) goes through a range sort, whose
    partition counts give each row its number, so no single task holds the log.
    """
    order = order or ["file", "block", "line"]
    first = commits.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(*order))).where("_r = 1").drop("_r")
    return number_rows(first, order, "age")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, ... in a total order, by range partitions and the counts before each."""
    from .tables import written

    ranged = written(df.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ages")
    base = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_l", local).join(F.broadcast(base), "_p").withColumn(name, (F.col("_b") + F.col("_l")).cast("bigint")).drop("_p", "_b", "_l")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Open a repository: every file of the path, tails repaired, duplicates dropped, ages assigned."""
    return dedupe_with_age(parse_commits(valid_prefix(read_lines(spark, path))))


def newest_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.desc("file"), F.desc("block"), F.desc("line"))


def query_log(lines: DataFrame, predicate: Column, limit: int) -> DataFrame:
    """Ad-hoc search of a log with an early stop."""
    return lines.where(predicate).limit(limit)


def to_json_lines(commits: DataFrame) -> DataFrame:
    """Commits as JSON objects; nulls are left out, and the payload is JSON text inside ``d``."""
    marker = F.concat_ws("/", "scheme_ns", "scheme_version")
    none = lambda kind: F.lit(None).cast(kind)
    have = lambda name, kind="string": F.col(name) if name in commits.columns else none(kind)
    record = F.struct(marker.alias("s"), F.try_parse_json("payload").alias("d"), F.lit(True).alias("n"), F.col("checksum").alias("cs"))
    edit = F.struct(have("source_checksum").alias("sc"), F.col("checksum").alias("dc"), F.try_parse_json(have("edit")).alias("c"), marker.alias("s"))
    full = F.col("base").isNull()
    body = F.struct(F.when(full, record).alias("r"), F.col("base").alias("b"), F.when(~full, edit).alias("e"))
    known = [F.col(name).alias(short) for short, name in FIELDS.items() if name in commits.columns]
    return commits.select(F.to_json(F.struct(*known, body.alias("c"))).alias("value"))


def accepted(commits: DataFrame, existing: DataFrame | None, org: str, namespaces: list[str] | None = None, trusted: DataFrame | None = None) -> DataFrame:
    """Commits that a repository takes in: new ids of its organisation, in allowed namespaces, by trusted sessions.

    A full commit needs a scheme; a delta without one is of its base's, which was tested when it came.
    """
    ns = F.col("scheme_ns")
    fit = (F.col("org").isNull() | (F.col("org") == org)) & (F.col("base").isNotNull() | ns.isNotNull())
    if namespaces is not None:
        fit = fit & (ns.isNull() | ns.isin(namespaces))
    out = commits.where(fit).dropDuplicates(["id"])
    if trusted is not None:
        out = out.join(trusted.select("session").distinct(), "session", "left_semi").select(commits.columns)
    return out if existing is None else out.join(existing.select("id"), "id", "left_anti").select(commits.columns)


def append_log(commits: DataFrame, existing: DataFrame | None, path: str) -> None:
    """Append commits whose id the log doesn't hold yet."""
    fresh = commits if existing is None else commits.join(existing.select("id"), "id", "left_anti")
    to_json_lines(fresh.dropDuplicates(["id"])).write.mode("append").text(path)


def sample_log(entries: DataFrame, share: float = 0.1, seed: int = 1) -> DataFrame:
    return entries.sample(share, seed)
