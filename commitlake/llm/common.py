"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

_SCRATCH: list[tuple[SparkSession, str]] = []
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a local temp folder only in a local session that names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="commitlake-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/commitlake/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _SCRATCH:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone at interpreter exit
            return


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The plan after it starts from files that outlive executors, so non-deterministic columns (row ids) keep their
    values on a retry, and each row is computed once (a DataFrame checkpoint computes its lineage twice).
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of ``durable`` that nothing to come reads, and let Spark drop shuffle files of phases now over."""
    drop_path(table.sparkSession, table._scratch)
    release(table.sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files go once their plans are unreachable on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes: texts may be very long.  The same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def reserve(df: DataFrame, *names: str) -> None:
    """Refuse inputs whose extra columns would clash with a column that the operator makes."""
    clash = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if clash:
        raise ValueError(f"input columns clash with operator columns: {', '.join(clash)}")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", max_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """Join a large side to an aggregated one whose keys may be hot.

    The small side is written once and counted: up to ``max_rows`` rows it is broadcast; beyond that both sides are dealt by key and a
    salt, the small side once per salt, so that a hot key is split over ``salts`` tasks.  Null keys match null keys.
    """
    small = durable(small.select(*[F.col(k).alias(f"__s_{k}") for k in keys], *[c for c in small.columns if c not in keys]), "small")
    on = lambda b, s: [b[k].eqNullSafe(s[f"__s_{k}"]) for k in keys]
    if small.limit(max_rows + 1).count() <= max_rows:
        out = big.join(F.broadcast(small), on(big, small), how)
    else:
        left = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
        right = small.withColumn("__salt2", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        out = left.join(right, [*on(left, right), left["__salt"] == right["__salt2"]], how).drop("__salt", "__salt2")
    return out.drop(*[f"__s_{k}" for k in keys])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each one grouped aggregation and one join on
    the node; a written table cuts the lineage after each round, and the star count stops the loop.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    signature = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["n"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low2, large["a"] == low2["n"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = durable(small.where("a <> b").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(now) == signature and now[0] == now[2]:
            break
        signature = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def split_running(df: DataFrame, group: str, order: list, value: str, prefix: str, rows: int = 2_000, max_buckets: int = 65_536) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in the order of a hash column ``order[0]`` and the rest.

    The upper 32 bits of the (non-negative 63-bit) hash deal each group into a bucket for every ``rows`` of its rows,
    so that any group is sorted by many tasks; bucket totals, one row per bucket, carry the sum across buckets.
    Adds ``prefix`` (running sum before the row) and keeps every input column.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    sizes = sizes.select(group, F.least(F.lit(max_buckets), F.greatest(F.lit(1), F.ceil(F.col("__n") / rows))).cast("long").alias("__nb"))
    cut = join_small(df, sizes, [group]).withColumn("__bk", F.floor(F.shiftright(F.col(order[0]), 31).cast("double") / F.lit(float(1 << 32)) * F.col("__nb")).cast("long"))
    totals = cut.groupBy(group, "__bk").agg(F.sum(value).alias("__t"))
    base = totals.select(group, "__bk", F.coalesce(F.sum("__t").over(W.partitionBy(group).orderBy("__bk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy(group, "__bk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = cut.withColumn("__in", inner)
    out = join_small(local, base, [group, "__bk"])
    return out.withColumn(prefix, (F.col("__base") + F.col("__in")).cast("long")).drop("__nb", "__bk", "__base", "__in")
