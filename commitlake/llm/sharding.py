"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows get a durable row number; its hash deals them into ``PARTITIONS`` logical partitions, more where each would
otherwise exceed ``ROWS_PER_PARTITION`` rows.  For each partition the
driver draws how many of its rows go to each shard, from the multivariate hypergeometric law of a uniform permutation
(one small row of counts per partition, never a document).  Each partition is permuted locally, its rows are sent to
shards by those exact counts, and each shard is permuted again to give slots.  Shard sizes differ by one row at most.

Defined results: null texts count as empty; a very long text is one row like any other (only row numbers are permuted
and texts move once); null or repeated ids and fully repeated rows are separate rows, each with a slot of its own; an
empty table gives an empty result; extra columns pass through, but for ``shard`` and ``slot``, which are refused.  Copies of a text are not kept together: a uniform shuffle has no groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from .common import durable, join_small, reserve, table

PARTITIONS, ROWS_PER_PARTITION, MAX_PARTITIONS = 256, 50_000, 16_384
BLOCKS = 16  # parts of a shard that are permuted apart, at least


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact-count draw; beyond numpy's limit of 10^9 by inverting the law within 14 deviations of its mean."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    dev = np.sqrt(mean * (bad / total) * ((total - n) / max(total - 1, 1))) + 1
    lo, hi = max(0, n - bad, int(mean - 14 * dev)), min(n, good, int(mean + 14 * dev) + 1)
    k = np.arange(lo, hi, dtype=float)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    return lo + int(np.searchsorted(np.cumsum(weights) / weights.sum(), rng.random(), side="right"))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """counts[p] rows of partition p dealt to shards: rows sum to counts, columns to sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, n in enumerate(counts):
        pool, need = sum(left), n
        for s in range(n_shards):
            take = hypergeometric(rng, left[s], pool - left[s], need)
            out[p, s] = take
            pool -= left[s]
            need -= take
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
    return out


def deal(rows: DataFrame, n_shards: int, seed: int = 17, partitions: int = PARTITIONS) -> DataFrame:
    """Add ``shard`` and ``slot`` to the rows of a table that has a unique stable ``__uid``; narrow tables only."""
    spark = rows.sparkSession
    total = rows.count()
    parts = min(MAX_PARTITIONS, max(partitions, -(-total // ROWS_PER_PARTITION)))
    keyed = rows.withColumn("__p", F.pmod(F.xxhash64("__uid", F.lit(seed)), F.lit(parts)))
    found = {r["__p"]: r["n"] for r in keyed.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # at most MAX_PARTITIONS rows
    order = sorted(found)
    matrix = communication_matrix([found[p] for p in order], n_shards, seed)
    ends = spark.createDataFrame([(int(p), [int(x) for x in np.cumsum(matrix[i])]) for i, p in enumerate(order)], "__p long, __ends array<long>")
    local = F.row_number().over(W.partitionBy("__p").orderBy(F.xxhash64("__uid", F.lit(seed + 1)), "__uid")) - 1
    sent = keyed.withColumn("__r", local).join(F.broadcast(ends), "__p")  # MAX_PARTITIONS x n_shards numbers at most
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__r"))).cast("int"))
    # the second permutation, by blocks of a random key, so that a shard is not one task's work
    blocks = max(BLOCKS, -(-total // (n_shards * ROWS_PER_PARTITION)))
    key = F.xxhash64("__uid", F.lit(seed + 2))
    sent = sent.withColumn("__k", key).withColumn("__b", F.least(F.lit(blocks - 1), F.floor((F.shiftrightunsigned("__k", 32).cast("double") / float(1 << 32)) * blocks)).cast("long"))
    per_block = sent.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    base = per_block.select("shard", "__b", F.coalesce(F.sum("__n").over(W.partitionBy("shard").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    slot = F.row_number().over(W.partitionBy("shard", "__b").orderBy(F.shiftrightunsigned("__k", 32), "__k", "__uid")) - 1
    out = join_small(sent.withColumn("__s", slot), base, ["shard", "__b"])
    return out.withColumn("slot", (F.col("__base") + F.col("__s")).cast("long")).drop("__p", "__r", "__ends", "__k", "__b", "__s", "__base")


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 17, partitions: int = PARTITIONS) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot``: texts cross the network once, after the draw."""
    reserve(docs, "shard", "slot", "__uid")
    kept = durable(docs.withColumn("__uid", F.monotonically_increasing_id()), "shard-rows")
    placed = durable(deal(kept.select("__uid"), n_shards, seed, partitions), "shard-slots")
    return kept.join(placed.hint("shuffle_hash"), "__uid").drop("__uid")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("__uid"))
    out = deal(durable(rows, "shard-narrow"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
