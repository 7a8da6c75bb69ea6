"""N-way merge relative to a base as one grouped aggregation.

Per type: a scalar takes the newest value that a leaf set to other than the base, else null if a leaf removed it,
else the base; a set takes the base without what was removed plus what was added; a map does so by entry, where an
edit beats a removal.  Roots rank below other leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .change import _map, _set


def merge_records(leaves: DataFrame, base: DataFrame, fields: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """leaves (key, id, ts, is_root, fields) and base (key, fields) -> (key, fields).  One shuffle on the key."""
    keys = keys or ["key"]
    b = base.select(*keys, *[F.col(n).alias(f"_b_{n}") for n in fields])
    both = leaves.join(b, keys, "left")
    rank = F.struct((~F.coalesce(F.col("is_root"), F.lit(False))).alias("x"), F.col("ts").alias("y"), F.col("id").alias("z"))
    aggs: list[Column] = []
    for n, kind in fields.items():
        v, old = F.col(n), F.col(f"_b_{n}")
        if kind == "set":
            aggs += [F.first(old).alias(f"_0_{n}"), F.array_distinct(F.flatten(F.collect_set(F.array_except(_set(old), _set(v))))).alias(f"_1_{n}"), F.array_distinct(F.flatten(F.collect_set(F.array_except(_set(v), _set(old))))).alias(f"_2_{n}")]  # equal changes meet before the shuffle
        elif kind == "map":
            put, gone = _entries(v, old, rank)
            aggs += [F.any_value(_map(old)).alias(f"_0_{n}"), F.array_distinct(F.flatten(F.collect_set(gone))).alias(f"_1_{n}"), F.array_sort(F.flatten(F.collect_list(put))).alias(f"_2_{n}")]
        else:
            changed = ~v.eqNullSafe(old)
            aggs += [F.first(old).alias(f"_0_{n}"), F.max(F.when(changed & v.isNotNull(), F.struct(rank.alias("r"), v.alias("v")))).alias(f"_2_{n}"), F.bool_or(changed & v.isNull()).alias(f"_1_{n}")]
    grouped = both.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *[_result(n, k).alias(n) for n, k in fields.items()])


def _entries(new: Column, old: Column, rank: Column) -> tuple[Column, Column]:
    """Entries that a leaf put, with its rank, and keys that it removed."""
    put = F.map_filter(_map(new), lambda k, x: ~_map(old)[k].eqNullSafe(x))
    gone = F.map_keys(F.map_filter(_map(old), lambda k, x: ~F.map_contains_key(_map(new), k)))
    return F.transform(F.map_entries(put), lambda e: F.struct(rank.alias("r"), e["key"].alias("k"), e["value"].alias("v"))), gone


def _result(n: str, kind: str) -> Column:
    old, gone, new = F.col(f"_0_{n}"), F.col(f"_1_{n}"), F.col(f"_2_{n}")
    if kind == "set":
        out = F.array_sort(F.array_union(F.array_except(_set(old), gone), new))
        return F.when(F.size(out) > 0, out)
    if kind == "map":
        kept = F.map_filter(_map(old), lambda k, v: ~F.array_contains(gone, k))
        zero = F.create_map().cast("map<string,string>")
        put = F.aggregate(new, zero, lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
        out = F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(put, k)), put)
        return F.when(F.size(out) > 0, out)
    return F.when(new.isNotNull(), new["v"]).when(gone, F.lit(None)).otherwise(old)


def rebase(base: DataFrame, head: DataFrame, local: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Local edits on top of the head: a merge in which the local record is the newest leaf.  Inputs (key, fields)."""
    mark = lambda df, at: df.select("key", F.lit(at).alias("id"), F.lit(at).alias("ts"), F.lit(False).alias("is_root"), *fields)
    return merge_records(mark(head, 0).unionByName(mark(local, 1)), base, fields)


def merge_commits(merged: DataFrame, leaves: DataFrame) -> DataFrame:
    """Merge commits for keys with more than one leaf: the merged record, its parents and a time after theirs."""
    by = leaves.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("parents"), F.max("ts").alias("ts")).where(F.size("parents") > 1)
    ident = F.md5(F.concat_ws("|", F.col("key").cast("string"), F.col("parents").cast("array<string>")).cast("binary"))
    return by.join(merged, "key").withColumn("id", ident)
