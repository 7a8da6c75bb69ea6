"""Sets, maps and arrays of canonical values as Column expressions; a set is an array kept distinct and sorted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import col


def canonical(json: str | Column) -> Column:
    """JSON text with sorted keys; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(col(json)))


def checksum(*fields: str | Column) -> Column:
    """md5 of field values in a given order; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), col(f).cast("string")), F.lit("-")) for f in fields]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def as_set(a: str | Column) -> Column:
    return F.array_sort(F.array_distinct(col(a)))


def intersection(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_intersect(col(a), col(b)))


def symmetric_difference(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(col(a), col(b)), F.array_except(col(b), col(a))))


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_except(col(a), col(b)))


def subtract_keeping_repeats(a: str | Column, b: str | Column) -> Column:
    return F.filter(col(a), lambda x: ~F.array_contains(col(b), x))


def union(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_union(col(a), col(b)))


def equal_sets(a: str | Column, b: str | Column) -> Column:
    return as_set(a) == as_set(b)


def toggle(a: str | Column, value: Column) -> Column:
    return F.array_sort(F.when(F.array_contains(col(a), value), F.array_remove(col(a), value)).otherwise(F.array_union(col(a), F.array(value))))


# sets of structured values: members are equal if their canonical JSON is


def by_value(a: str | Column) -> Column:
    """An array of JSON texts as a set of canonical ones."""
    return F.array_sort(F.array_distinct(F.transform(col(a), lambda x: F.to_json(F.try_parse_json(x)))))


def has_by_value(a: str | Column, value: str | Column) -> Column:
    return F.array_contains(by_value(a), canonical(value))


def add_by_value(a: str | Column, value: str | Column) -> Column:
    return union(by_value(a), F.array(canonical(value)))


def delete_by_value(a: str | Column, value: str | Column) -> Column:
    return F.array_remove(by_value(a), canonical(value))


def union_by_value(a: str | Column, b: str | Column) -> Column:
    return union(by_value(a), by_value(b))


def subtract_by_value(a: str | Column, b: str | Column) -> Column:
    return subtract(by_value(a), by_value(b))


def equal_by_value(a: str | Column, b: str | Column) -> Column:
    return by_value(a) == by_value(b)


def has_duplicates(a: str | Column) -> Column:
    return F.size(F.array_distinct(col(a))) < F.size(col(a))


def last_value(a: str | Column) -> Column:
    return F.try_element_at(col(a), F.lit(-1))


def slices(a: str | Column, size: int) -> Column:
    """Consecutive runs of ``size`` elements."""
    at = F.when(F.size(col(a)) > 0, F.sequence(F.lit(1), F.size(col(a)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(col(a), i, F.lit(size)))


def cartesian(a: str | Column, b: str | Column) -> Column:
    return F.flatten(F.transform(col(a), lambda x: F.transform(col(b), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def equal_maps(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.map_entries(col(a))) == F.array_sort(F.map_entries(col(b)))
