"""Activity and metric aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


QUANTILES = (0.5, 0.9, 0.99)


def activity(events: DataFrame, now: Column, user: str = "user_id", ts: str = "ts", excluded: DataFrame | None = None) -> DataFrame:
    """(dau, wau, mau, scan_size): distinct users of the last 1, 7 and 30 days.

    Events are first reduced to each user's last one, so the distinct counts are plain counts over users.
    """
    rows = events if excluded is None else events.join(excluded, user, "left_anti")
    last = rows.groupBy(user).agg(F.max(ts).alias("last"), F.count("*").alias("n"))
    within = lambda days: F.count_if(F.col("last") >= now - F.expr(f"interval {days} days"))
    return last.agg(within(1).alias("dau"), within(7).alias("wau"), within(30).alias("mau"), F.coalesce(F.sum("n"), F.lit(0)).alias("scan_size"))


def quantiles(metrics: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(by, quantiles): for each share the least value that at least this share of a metric's values don't exceed.

    Exact: values are counted before they are ranked, so equal ones meet before the shuffle.
    """
    counts = metrics.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto, every = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    share = F.sum("_n").over(upto) / F.sum("_n").over(every)
    ranked = counts.select(*by, value, share.alias("_share"))
    return ranked.groupBy(*by).agg(F.array(*[F.min(F.when(F.col("_share") >= p, F.col(value))) for p in shares]).alias("quantiles"))


def metric_rollup(metrics: DataFrame, by: list[str], value: str, ts: str) -> DataFrame:
    """Counter, gauge, histogram and summary figures of each metric; a metric without values has no quantiles."""
    rolled = metrics.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max_by(value, ts).alias("latest"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(metrics, by, value).select(*[F.col(n).alias(f"_q_{n}") for n in by], "quantiles")
    same = [F.col(n).eqNullSafe(F.col(f"_q_{n}")) for n in by]
    return rolled.join(q, same, "left").drop(*[f"_q_{n}" for n in by])


def histogram(metrics: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts for each upper bound."""
    le = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), (F.col(value) <= b).alias("hit")) for b in bounds]))
    return metrics.select(*by, le.alias("_b")).groupBy(*by, F.col("_b.le").alias("le")).agg(F.count_if("_b.hit").alias("n"))


def exposition(rollup: DataFrame, name: str) -> DataFrame:
    """One text line per figure, as scrapers read them."""
    lines = F.array(F.concat_ws(" ", F.concat(F.col(name), F.lit("_count")), F.col("n").cast("string")), F.concat_ws(" ", F.concat(F.col(name), F.lit("_sum")), F.col("total").cast("string")))
    return rollup.select(F.explode(lines).alias("value"))


def moving_average(rows: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    return rows.withColumn("moving_average", F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)))


def weighted_average(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_average"))
