"""Records of commits: full snapshots, or a base and an edit whose checksums must agree."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions.collections import checksum
from ..sources.runs import map_runs
from ..sources.tables import written
from . import histories
from .change import patch
from .graph import _elsewhere, _grown, _kind, _of_keys, newest_per


def record_checksum(record: str, fields: dict[str, tuple[str, str]]) -> Column:
    value = lambda n, k: F.to_json(F.array_sort(F.map_entries(F.col(f"{record}.{n}")))) if k == "map" else (F.to_json(F.col(f"{record}.{n}")) if k == "set" else F.col(f"{record}.{n}"))
    return checksum(*[value(n, k) for n, (k, _) in fields.items()])


def materialise(commits: DataFrame, fields: dict[str, tuple[str, str]], snapshots: DataFrame | None = None) -> DataFrame:
    """Adds ``value`` (the record) and ``corrupt`` to commits (id, base, record, edit, source_checksum, checksum).

    ``snapshots`` (id, base, record) holds the full commits where ``commits`` may lack some of them.

    A full commit has a record; a delta has a base, which is a full commit, and an edit: one self-join on the base.
    A delta is corrupt if its base's or its result's checksum isn't the stored one, or if the base is absent.
    """
    source = commits if snapshots is None else snapshots
    full = source.where("base is null").select(F.col("id").alias("_full"), F.col("record").alias("_base"))
    # a full commit joins itself, so that no join key is null
    both = commits.join(full, F.coalesce("base", "id") == F.col("_full"), "left").withColumn("_patched", F.when(F.col("_base").isNotNull(), patch(fields, "_base", "edit")))
    ok = F.coalesce((record_checksum("_base", fields) == F.col("source_checksum")) & (record_checksum("_patched", fields) == F.col("checksum")), F.lit(False))
    delta = F.col("base").isNotNull()
    value = F.when(~delta, F.col("record")).when(ok, F.col("_patched"))
    return both.withColumns({"value": value, "corrupt": delta & ~ok}).drop("_full", "_base", "_patched")


def with_fallback(materialised: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Corrupt commits take the record of the newest good commit of their key, or null; ``others`` are all its commits."""
    good = newest_per((materialised if others is None else others).where("not corrupt"), "key").select("key", F.col("value").alias("_good"))
    return materialised.join(good, "key", "left").withColumn("value", F.when(F.col("corrupt"), F.col("_good")).otherwise(F.col("value"))).drop("_good")


def newest_good_ancestor(materialised: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, good): for each corrupt commit, its nearest ancestors that aren't corrupt."""
    if max_depth is not None or "key" not in materialised.columns:
        return _good_by_levels(materialised, max_depth)
    schema = StructType([_kind(materialised, "key", "key"), *[_kind(materialised, n) for n in ("id", "good", "away")]])
    out = written(map_runs(materialised.select("key", "id", "parents", "corrupt"), [], histories.newest_good, schema, histories.LIMIT), "good")
    found, other = out.where("good is not null").select("id", "good"), out.where("good is null")
    if other.isEmpty():
        return found
    if not _elsewhere(other.where("away is not null"), materialised).isEmpty():
        return _good_by_levels(materialised)
    long = other.where("away is null").select("key")
    return found if long.isEmpty() else found.unionByName(_good_by_levels(_of_keys(materialised, long)))


def _good_by_levels(materialised: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``newest_good_ancestor`` by a round of joins for each level."""
    step = materialised.select(F.col("id").alias("at"), F.explode("parents").alias("up"))
    bad = materialised.select(F.col("id").alias("up"), F.col("corrupt").alias("bad"))
    frontier = materialised.where("corrupt").select("id", F.col("id").alias("at"))
    found = seen = None
    for n in count(1) if max_depth is None else range(1, max_depth + 1):
        more = frontier.join(step, "at").join(bad, "up").select("id", F.col("up").alias("at"), "bad").distinct()
        more = written(more if seen is None else more.join(seen, ["id", "at"], "left_anti"), "good")
        good = more.where("not bad").select("id", F.col("at").alias("good"))
        found = _grown(found, good, n, "good")
        frontier = more.where("bad").select("id", "at")
        seen = _grown(seen, frontier, n, "good")
        if frontier.isEmpty():
            break
    return found.distinct()


def delta_base(commits: DataFrame) -> DataFrame:
    """(id, base): for each commit, the newest full snapshot of its key before it (in log order), null where there is none."""
    order = W.partitionBy("key").orderBy("age").rowsBetween(W.unboundedPreceding, -1)
    return commits.select("id", F.last(F.when(F.col("is_full"), F.col("id")), ignorenulls=True).over(order).alias("base"))


def deltas(commits: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Full records against the newest earlier full snapshot: adds ``full_length``, ``delta_length`` and ``kept``."""
    from .change import delta_kept, diff

    snap = commits.where("is_full").select(F.col("id").alias("base"), F.col("record").alias("_r"))
    both = commits.join(snap, "base", "left")
    edit = F.to_json(diff({n: k for n, (k, _) in fields.items()}, "_r", "record"))
    full = F.to_json("record")
    return both.select("id", F.length(full).alias("full_length"), F.length(edit).alias("delta_length"), (F.col("_r").isNotNull() & delta_kept(full, edit, F.col("age"))).alias("kept"))
