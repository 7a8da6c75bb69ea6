"""Mutation packs: what happened to the fields of an item, as ``array<struct<field, local, old>>`` in order of events.

A pack holds one mutation for each field, the first, whose ``old`` is the value from before all of them.  An empty pack
and null are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col

PACK = "array<struct<field:string,local:boolean,old:string>>"


def mutation(field: str | Column, local: str | Column, old: str | Column) -> Column:
    parts = (F.lit(field) if isinstance(field, str) else field).alias("field"), col(local).alias("local"), col(old).cast("string").alias("old")
    return F.struct(*parts)


def held(pack: str | Column) -> Column:
    return F.coalesce(col(pack), F.array().cast(PACK))


def optimised(pack: str | Column) -> Column:
    """The first mutation of each field."""
    seen = lambda acc, m: F.exists(acc, lambda x: x["field"] == m["field"])
    return F.aggregate(held(pack), F.array().cast(PACK), lambda acc, m: F.when(seen(acc, m), acc).otherwise(F.array_append(acc, m)))


def append(pack: str | Column, more: str | Column) -> Column:
    return optimised(F.concat(held(pack), held(more)))


def length(pack: str | Column) -> Column:
    return F.size(held(pack))


def at(pack: str | Column, index: int) -> Column:
    return F.get(held(pack), F.lit(index))


def without_first(pack: str | Column) -> Column:
    return F.slice(held(pack), F.lit(2), F.greatest(F.lit(0), length(pack)))


def has_remote(pack: str | Column) -> Column:
    return F.exists(held(pack), lambda m: ~m["local"])


def has_only_local(pack: str | Column) -> Column:
    return ~has_remote(pack)


def has_field(pack: str | Column, *fields: str) -> Column:
    return F.exists(held(pack), lambda m: m["field"].isin(*fields))


def subtract_fields(pack: str | Column, other: str | Column) -> Column:
    gone = F.transform(held(other), lambda m: m["field"])
    return F.filter(held(pack), lambda m: ~F.array_contains(gone, m["field"]))


def collect(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, pack) from a row for each mutation (key, order, field, local, old): the first of each field, map-side combined."""
    first = events.groupBy(key, "field").agg(F.min(F.struct(F.col(order).alias("seq"), "local", "old")).alias("m"))
    rows = F.sort_array(F.collect_list(F.struct("m.seq", "field", "m.local", "m.old")))
    return first.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["field"].alias("field"), r["local"].alias("local"), r["old"].alias("old"))).alias("pack"))
