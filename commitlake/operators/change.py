"""Field-level diff and patch of typed records.

A record is a struct column or a set of columns; a change is ``(field, op, value)`` with op 1 for insert and -1 for
delete, and a value that is a string for scalars, a JSON array for sets and a JSON object for maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHANGE = "array<struct<field:string,op:int,value:string>>"
_SET, _MAP = "array<string>", "map<string,string>"


def _change(name: str, op: int, value: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"))


def _set(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_SET))


def _map(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast(_MAP))


def diff_field(name: str, kind: str, a: Column, b: Column) -> Column:
    """An array of at most two changes."""
    if kind == "set":
        gone, new = F.array_except(_set(a), _set(b)), F.array_except(_set(b), _set(a))
        parts = [(-1, F.size(gone) > 0, F.to_json(F.array_sort(gone))), (1, F.size(new) > 0, F.to_json(F.array_sort(new)))]
    elif kind == "map":
        gone = F.map_filter(_map(a), lambda k, v: ~F.map_contains_key(_map(b), k))
        new = F.map_filter(_map(b), lambda k, v: ~_map(a)[k].eqNullSafe(v))
        parts = [(-1, F.size(gone) > 0, F.to_json(gone)), (1, F.size(new) > 0, F.to_json(new))]
    else:
        other = ~a.eqNullSafe(b)
        parts = [(-1, other & b.isNull(), a), (1, other & b.isNotNull(), b)]
    return F.array_compact(F.array(*[F.when(cond, _change(name, op, value)) for op, cond, value in parts]))


def diff(fields: dict[str, str], a: str, b: str) -> Column:
    """Changes that lead from struct ``a`` to struct ``b``; either may be null (an empty record)."""
    return F.concat(*[diff_field(n, k, F.col(f"{a}.{n}"), F.col(f"{b}.{n}")) for n, k in fields.items()]).cast(CHANGE)


def changed_fields(fields: dict[str, str], a: str, b: str) -> Column:
    same = lambda n, k: equal_maps_safe(F.col(f"{a}.{n}"), F.col(f"{b}.{n}")) if k == "map" else F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return F.array_compact(F.array(*[F.when(~same(n, k), F.lit(n)) for n, k in fields.items()]))


def changed_by_commit(commits: DataFrame, fields: dict[str, str], record: str = "record") -> DataFrame:
    """(id, fields): what a commit changed against any of its parents that are in the log.  Commits (id, parents, record)."""
    up = commits.select("id", F.explode("parents").alias("_parent"), F.col(record).alias("_new"))
    pairs = up.join(commits.select(F.col("id").alias("_parent"), F.col(record).alias("_old")), "_parent")
    each = pairs.select("id", changed_fields(fields, "_old", "_new").alias("_f"))
    some = each.groupBy("id").agg(*[F.bool_or(F.array_contains("_f", n)).alias(f"_{i}") for i, n in enumerate(fields)])
    return some.select("id", F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(fields)])).alias("fields"))


def equal_maps_safe(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def patch_field(name: str, kind: str, type_: str, value: Column, changes: Column) -> Column:
    own = F.filter(changes, lambda c: c["field"] == name)
    if kind == "set":
        listed = lambda c: F.from_json(c["value"], _SET)
        out = F.aggregate(own, _set(value), lambda acc, c: F.when(c["op"] == 1, F.array_union(acc, listed(c))).otherwise(F.array_except(acc, listed(c))))
        return F.when(F.size(out) > 0, F.array_sort(out))
    if kind == "map":
        put = lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k)), m)
        cut = lambda acc, m: F.map_filter(acc, lambda k, v: ~(F.map_contains_key(m, k) & m[k].eqNullSafe(v)))
        out = F.aggregate(own, _map(value), lambda acc, c: F.when(c["op"] == 1, put(acc, F.from_json(c["value"], _MAP))).otherwise(cut(acc, F.from_json(c["value"], _MAP))))
        return F.when(F.size(out) > 0, out)
    text = F.aggregate(own, value.cast("string"), lambda acc, c: F.when(c["op"] == 1, c["value"]).when(acc == c["value"], F.lit(None)).otherwise(acc))
    return text.cast(type_)


def patch(fields: dict[str, tuple[str, str]], record: str, changes: str) -> Column:
    """The record with changes applied in order; ``fields`` gives (kind, Spark type).  A delete spares a newer value."""
    return F.struct(*[patch_field(n, k, t, F.col(f"{record}.{n}"), F.col(changes)).alias(n) for n, (k, t) in fields.items()])


def from_wire(edit: Column, dates: list[str]) -> Column:
    """Changes of an edit's JSON: {field: [{operation, vType, value}]}; tagged values are unwrapped, dates are milliseconds."""
    read = F.from_json(edit, "map<string,array<struct<operation:int,value:string>>>")

    def of(field: Column, c: Column) -> Column:
        bare = F.coalesce(F.get_json_object(c["value"], "$.__v"), c["value"])
        when = F.round(bare.try_cast("double") * 1000).cast("bigint").cast("string")
        value = F.when(field.isin(dates), when).otherwise(bare) if dates else bare
        return F.struct(field.alias("field"), c["operation"].alias("op"), value.alias("value"))

    return F.flatten(F.transform(F.map_entries(read), lambda e: F.transform(e["value"], lambda c: of(e["key"], c)))).cast(CHANGE)


def to_wire(changes: Column, types: dict[str, str]) -> Column:
    """The JSON that ``from_wire`` reads: sets and dates carry their tags, numbers, booleans and maps are bare JSON."""
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])

    def one(c: Column) -> Column:
        kind = kinds[c["field"]]
        tagged = F.when(kind == "set", F.concat(F.lit('{"__t":"S","__v":'), c["value"], F.lit("}"))).when(kind == "date", F.concat(F.lit('{"__t":"D","__v":'), (c["value"].cast("double") / 1000).cast("string"), F.lit("}")))
        # a struct of one string, written as JSON, quotes and escapes it
        quoted = F.regexp_extract(F.to_json(F.struct(c["value"].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        value = F.coalesce(tagged, F.when(kind.isin("number", "boolean", "map"), c["value"]).otherwise(quoted))
        return F.concat(F.lit('{"changeType":"fd","operation":'), c["op"].cast("string"), F.lit(',"vType":"'), kind, F.lit('","value":'), value, F.lit("}"))

    names = F.array_distinct(F.transform(changes, lambda c: c["field"]))
    lists = F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('":['), F.array_join(F.transform(F.filter(changes, lambda c: c["field"] == n), one), ","), F.lit("]")))
    return F.concat(F.lit("{"), F.array_join(lists, ","), F.lit("}"))


def concat_changes(*changes: str) -> Column:
    return F.concat(*changes)


def has_changes(changes: str) -> Column:
    return F.size(changes) > 0


def contains_field(changes: str, name: str) -> Column:
    return F.exists(changes, lambda c: c["field"] == name)


def delta_kept(full: Column, delta: Column, age: Column, limit: float = 0.85, full_every: int = 20) -> Column:
    """Store a delta if it is short enough against the full text; one in ``full_every`` is full, by a hash of its age."""
    return (F.length(delta) <= F.lit(limit) * F.length(full)) & (F.pmod(F.xxhash64(age), F.lit(full_every)) != 0)
