"""The query operator: scheme, predicate and sort over current items, chained and kept up to date by age."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cmp_to_key
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Predicate = Column | Callable[[dict[str, Any]], Column] | None


@dataclass
class Query:
    """Source: a DataFrame of items (key, item fields, scheme_ns, age, is_deleted) or another query.

    ``predicate`` is a Column, or a function of ``ctx`` that gives one.  A row-wise Python test goes through ``where_python``.
    """

    source: DataFrame | Query
    scheme: str | None = None
    predicate: Predicate = None
    sort: list[Column] = field(default_factory=list)
    ctx: dict[str, Any] = field(default_factory=dict)
    name: str = ""

    def condition(self) -> Column:
        p = self.predicate(self.ctx) if callable(self.predicate) else self.predicate
        return F.lit(True) if p is None else p

    @property
    def id(self) -> str:
        """By source, scheme, predicate, sort and context, so that different queries never share a cache."""
        base = self.source.id if isinstance(self.source, Query) else self.name
        parts = [base, self.scheme, str(self.condition()), [str(s) for s in self.sort], self.ctx]
        return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def members(self) -> DataFrame:
        items = self.source.members() if isinstance(self.source, Query) else self.source
        out = items if self.scheme is None else items.where(F.col("scheme_ns") == self.scheme)
        if "is_deleted" in items.columns:
            out = out.where(~F.coalesce("is_deleted", F.lit(False)))
        return out.where(self.condition())

    def results(self) -> DataFrame:
        """Sorted; ties go by key."""
        return self.members().orderBy(*self.sort, "key")

    def count(self) -> int:
        return self.members().count()

    def keys(self) -> DataFrame:
        return self.members().select("key")

    def has(self, key: Any) -> bool:
        return not self.members().where(F.col("key") == key).isEmpty()

    def membership(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) with ``member``: the test of ``has`` for a whole table."""
        own = self.keys().distinct().withColumn("member", F.lit(True))
        return keys.join(own, "key", "left").withColumn("member", F.coalesce("member", F.lit(False)))

    def value(self, key: Any) -> DataFrame:
        return self.members().where(F.col("key") == key)

    def top(self, n: int) -> DataFrame:
        return self.results().limit(n)

    def chain(self, **config) -> Query:
        return Query(self, **config)

    def save(self, path: str, age: int) -> None:
        """Cache: the keys of the result as of an age."""
        self.keys().select(F.lit(1).alias("version"), F.lit(self.id).alias("query_id"), F.lit(age).cast("long").alias("age"), "key").write.mode("overwrite").partitionBy("query_id").parquet(path)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        """(age, key) of this query; other versions of the cache are ignored."""
        return spark.read.parquet(path).where((F.col("version") == 1) & (F.col("query_id") == self.id)).select("age", "key")


def where_python(items: DataFrame, test: Callable[[dict[str, Any]], bool]) -> DataFrame:
    """The slow path: an arbitrary test of a row, by Arrow batches."""

    def run(batches):
        for b in batches:
            yield b[[bool(test(r)) for r in b.to_dict("records")]] if len(b) else b

    return items.mapInPandas(run, items.schema)


def sorted_by(results: DataFrame, comparator: Callable[[dict, dict], int], max_rows: int = 10_000) -> pd.DataFrame:
    """A comparator needs the rows in one place: for small results only, and refused beyond ``max_rows``."""
    rows = [r.asDict() for r in results.limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise ValueError("too many rows for a comparator; sort by columns")
    return pd.DataFrame(sorted(rows, key=cmp_to_key(comparator)), columns=results.columns)


def refresh(query: Query, cached: DataFrame, cached_age: int) -> DataFrame:
    """Keys of the result now, from the keys cached at an age: only items changed since are tested again."""
    items = query.source.members() if isinstance(query.source, Query) else query.source
    changed = items.where(F.col("age") > cached_age)
    kept = cached.select("key").join(changed.select("key"), "key", "left_anti")
    if isinstance(query.source, Query):  # a key that left the parent leaves the child
        kept = kept.join(items.select("key"), "key", "left_semi")
    again = Query(changed, query.scheme, query.predicate, query.sort, query.ctx)
    return kept.unionByName(again.keys())


def result_delta(old: DataFrame, new: DataFrame, value: str = "checksum") -> DataFrame:
    """(key, change): added, removed or updated between two results (key, value)."""
    a, b = old.select("key", F.col(value).alias("_a"), F.lit(1).alias("_x")), new.select("key", F.col(value).alias("_b"), F.lit(1).alias("_y"))
    kind = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "updated")
    return a.join(b, "key", "full").select("key", kind.alias("change")).where("change is not null")
