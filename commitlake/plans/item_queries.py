"""Queries of items: diff, patch, merge, schemes, records, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..functions import richtext
from ..functions.collections import checksum
from ..operators import change, graph, merge, records, schema, sync
from .graph_queries import _TWO, two_newest_leaves
from .registry import LOG, query
from .synthetic import synthetic_commits as log

FIELDS = {"k": "number", "event_type": "string"}
TYPED = {"k": ("number", "bigint"), "event_type": ("string", "string")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def against_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, old, new): records of each commit and of its first parent."""
    c = log(spark, sf_dir).select("id", F.get("parents", F.lit(0)).alias("parent"), F.struct(*FIELDS).alias("new"))
    return c.join(c.select(F.col("id").alias("parent"), F.col("new").alias("old")), "parent").select("id", "old", "new")


_PAIR = LOG + ", p as (select c.id, c.k, c.event_type, o.k as ok, o.event_type as oe from commits c join commits o on o.id = c.parents[1])"


@query(LOG + """, p as (select c.id, c.k, c.event_type, o.k as ok, o.event_type as oe from (select *, unnest(parents) as up from commits) c join commits o on o.id = c.up)
select id, concat_ws(',', case when bool_or(k is distinct from ok) then 'k' end, case when bool_or(event_type is distinct from oe) then 'event_type' end) as fields from p group by id""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against any parent of a commit."""
    c = log(spark, sf_dir).select("id", "parents", F.struct(*FIELDS).alias("record"))
    return change.changed_by_commit(c, FIELDS).select("id", F.array_join("fields", ",").alias("fields"))


@query(_PAIR + "select id, 'k' as field, 1 as op, k::varchar as value from p where k is distinct from ok union all select id, 'event_type', 1, event_type from p where event_type is distinct from oe")
def diff_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = against_parent(spark, sf_dir).select("id", F.explode(change.diff(FIELDS, "old", "new")).alias("c"))
    return d.select("id", "c.*")


@query(_PAIR + "select id, k, event_type from p")
def patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = against_parent(spark, sf_dir).withColumn("changes", change.diff(FIELDS, "old", "new"))
    return d.withColumn("r", change.patch(TYPED, "old", "changes")).select("id", "r.k", "r.event_type")


@query(LOG + """, m as (select key, min(id) as root from commits group by key),
b as (select c.key, c.k, c.event_type from commits c join m on m.root = c.id),
l as (select f.*, b.k as bk, b.event_type as be, len(f.parents) > 0 as nonroot from leaves f join b using (key))
select key, coalesce(arg_max(k, nonroot::int * 1e12 + id) filter (k is distinct from bk), min(bk)) as k,
  coalesce(arg_max(event_type, nonroot::int * 1e12 + id) filter (event_type is distinct from be), min(be)) as event_type from l group by key""")
def merge_scalar_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log(spark, sf_dir)
    base = c.groupBy("key").agg(F.min_by("k", "id").alias("k"), F.min_by("event_type", "id").alias("event_type"))
    return merge.merge_records(graph.leaves(c).withColumn("is_root", F.size("parents") == 0), base, FIELDS)


def line_leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each line of an order is a leaf of it."""
    part = (F.col("l_partkey") % 5).cast("string")
    m = F.map_from_arrays(F.array(F.lit("flag"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string"))), F.array("l_returnflag", "l_linestatus"))
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), number.alias("id"), number.alias("ts"), F.lit(False).alias("is_root"), F.array_sort(F.array_distinct(F.array("l_returnflag", "l_linestatus", part))).alias("tags"), m.alias("attrs"))
    base = lines.select("key").distinct().select("key", F.array(F.lit("A"), F.lit("F"), F.lit("0")).alias("tags"), F.create_map(F.lit("flag"), F.lit("N"), F.lit("p0"), F.lit("O")).alias("attrs"))
    return lines, base


_LINES = """
with l as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as id,
  list_distinct([l_returnflag, l_linestatus, (l_partkey % 5)::varchar]) as tags, l_returnflag as flag, 'p' || (l_partkey % 3)::varchar as pk, l_linestatus as pv from lineitem)"""


@query(_LINES + """, g as (select key, list_distinct(flatten(list(list_filter(['A', 'F', '0'], lambda x: not list_contains(tags, x))))) as gone,
  list_distinct(flatten(list(list_filter(tags, lambda x: not list_contains(['A', 'F', '0'], x))))) as new from l group by key)
select key, array_to_string(list_sort(list_distinct(list_concat(list_filter(['A', 'F', '0'], lambda x: not list_contains(gone, x)), new))), ',') as tags from g""")
def merge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, base = line_leaves(spark, sf_dir)
    return merge.merge_records(lines, base, {"tags": "set"}).select("key", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"))


@query(_LINES + """, e as (select key, id, 'flag' as k, flag as v from l union all select key, id, pk, pv from l),
ch as (select key, k, arg_max(v, id) as v from e where v is distinct from (case k when 'flag' then 'N' when 'p0' then 'O' end) group by key, k),
gone as (select distinct key from l where pk <> 'p0'),
o as (select key, k, v from ch union all select key, 'flag', 'N' from (select distinct key from l) d where not exists (select 1 from ch where ch.key = d.key and ch.k = 'flag')
  union all select key, 'p0', 'O' from (select distinct key from l) d where not exists (select 1 from ch where ch.key = d.key and ch.k = 'p0') and key not in (select key from gone))
select key, string_agg(k || '=' || v, ',' order by k) as attrs from o group by key""")
def merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, base = line_leaves(spark, sf_dir)
    out = merge.merge_records(lines, base, {"attrs": "map"})
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("key", F.array_join(pairs, ",").alias("attrs"))


@query(_LINES + """, p as (select key, id, tags, lag(tags) over (partition by key order by id) as old from l)
select key, id, array_to_string(list_sort(list_filter(old, lambda x: not list_contains(tags, x))), ',') as removed,
  array_to_string(list_sort(list_filter(tags, lambda x: not list_contains(old, x))), ',') as added from p where old is not null""")
def diff_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = line_leaves(spark, sf_dir)
    p = lines.withColumn("old", F.lag("tags").over(W.partitionBy("key").orderBy("id"))).where("old is not null")
    d = p.select("key", "id", change.diff_field("tags", "set", F.col("old"), F.col("tags")).alias("c"))
    part = lambda op: F.coalesce(F.array_join(F.from_json(F.get(F.filter("c", lambda x: x["op"] == op), F.lit(0))["value"], "array<string>"), ","), F.lit(""))
    return d.select("key", "id", part(-1).alias("removed"), part(1).alias("added"))


@query(LOG + """, h as (select * from heads), r as (select key, min(id) as id from commits group by key), b as (select c.* from commits c join r on r.id = c.id)
select h.key, case when b.k % 2 = 0 then 'local' else h.event_type end as event_type, h.k from h join b on b.key = h.key""")
def rebase_local_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local edits, to one field of the base where its k is even, on top of the head."""
    c = log(spark, sf_dir)
    base = c.groupBy("key").agg(F.min_by("k", "id").alias("k"), F.min_by("event_type", "id").alias("event_type"))
    local = base.withColumn("event_type", F.when(F.col("k") % 2 == 0, "local").otherwise(F.col("event_type")))
    return merge.rebase(base, graph.heads(c).select("key", *FIELDS), local, FIELDS)


# schemes


def registry() -> schema.SchemeRegistry:
    found = schema.SchemeRegistry()
    text = schema.FieldDef("string", required=True)
    found.register(schema.Scheme("message", 1, {"sender": text, "value": text}))
    found.register(schema.Scheme("message", 2, {"sender": text, "contents": text, "timestamp": schema.FieldDef("date", default=F.timestamp_millis(F.lit(0)))}, {"contents": F.col("value")}))
    found.register(schema.Scheme("message", 3, {"sender": text, "contents": text, "size": schema.FieldDef("number")}, {"size": F.length("contents").cast("double")}))
    return found


@query("select event_id, 3 as scheme_version, case when event_id % 3 = 2 then null else event_type end as contents, case when event_id % 3 = 2 then null else length(event_type)::double end as size from events")
def schema_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of versions 1 and 2 come to version 3; those already there pass."""
    ev = table(spark, sf_dir, "events").withColumn("scheme_version", (F.lit(1) + F.col("event_id") % 3).cast("int"))
    old = ev.select("event_id", "scheme_version", F.col("user_id").cast("string").alias("sender"), F.when(F.col("scheme_version") == 1, F.col("event_type")).alias("value"), F.when(F.col("scheme_version") == 2, F.col("event_type")).alias("contents"))
    return registry().upgrade(old, "message").select("event_id", "scheme_version", "contents", "size")


@query("select event_id, coalesce(case when value > 50 then event_type end, 'none') as kind, case when event_id % 4 <> 0 then 1 end as n_tags from events")
def normalise_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.Scheme("e", 1, {"kind": schema.FieldDef("string", default=F.lit("none")), "tags": schema.FieldDef("set")})
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("tags"))
    return schema.normalise(raw, s).select("event_id", "kind", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


@query("select event_id, case when value > 50 then '' else 'missing:kind,' end || 'unknown:k' as violations from events")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.Scheme("e", 1, {"kind": schema.FieldDef("string", required=True)})
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("kind"), F.col("props").alias("payload"), F.lit(False).alias("isDeleted"))
    return raw.select("event_id", F.array_join(schema.violations(raw, s, "payload"), ",").alias("violations"))


@query("select event_id, json_extract_string(props, '$.k')::double as k from events")
def decode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.Scheme("e", 1, {"k": schema.FieldDef("number")})
    return table(spark, sf_dir, "events").select("event_id", schema.decode(F.col("props"), s).alias("r")).select("event_id", "r.k")


# records


def with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full commits hold records, others edits; the edit of every thirteenth delta has a wrong checksum."""
    c = log(spark, sf_dir).withColumn("new", F.struct(*FIELDS))
    snap = c.where("base is null").select(F.col("id").alias("base"), F.col("new").alias("old"))
    d = c.join(snap, "base", "left")
    delta = F.col("base").isNotNull()
    bad = F.when(F.col("id") % 13 == 0, F.lit("bad")).otherwise(records.record_checksum("new", TYPED))
    return d.withColumns({"record": F.when(~delta, F.col("new")), "edit": F.when(delta, change.diff(FIELDS, "old", "new")), "source_checksum": F.when(delta, records.record_checksum("old", TYPED)), "checksum": bad}).drop("new", "old")


_CORRUPT = LOG + """, x as (select c.*, base is not null and (id % 13 = 0 or base not in (select id from commits where base is null)) as corrupt from commits c),
good as (select key, k, event_type from x where not corrupt qualify row_number() over (partition by key order by ts desc, id desc) = 1)"""


@query(_CORRUPT + "select x.id, x.corrupt, case when x.corrupt then good.k else x.k end as k, case when x.corrupt then good.event_type else x.event_type end as event_type from x left join good on good.key = x.key")
def corrupt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.with_fallback(records.materialise(with_records(spark, sf_dir), TYPED))
    return m.select("id", "corrupt", "value.k", "value.event_type")


@query(LOG + "select id, base from commits where base is not null")
def delta_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest full snapshot before each commit; the log makes every third commit of a key one."""
    bases = records.delta_base(log(spark, sf_dir).withColumn("is_full", F.col("rn") % 3 == 0))
    return log(spark, sf_dir).where("rn % 3 <> 0").select("id").join(bases, "id").where("base is not null")


@query("with recursive " + _TWO + """,
st as (select key, coalesce(lca, a) as base, a as l1, case when lca is not null then b end as l2 from lca),
tips as (select st.key, c.id, c.k, c.event_type, o.k as bk, o.event_type as be, len(c.parents) > 0 as nonroot from st join commits o on o.id = st.base join commits c on c.id = st.l1 or c.id = st.l2)
select key, coalesce(arg_max(k, nonroot::int * 1e12 + id) filter (k is distinct from bk), min(bk)) as k,
  coalesce(arg_max(event_type, nonroot::int * 1e12 + id) filter (event_type is distinct from be), min(be)) as event_type from tips group by key""")
def merge_at_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest leaves of each key, merged relative to their own merge base."""
    c = log(spark, sf_dir)
    two = two_newest_leaves(c)
    some = two.join(two.where("n = 2").select("key"), "key", "left_semi")
    state = graph.merge_bases(c, some).select("key", "base", "merged")
    base = state.select("key", F.col("base").alias("id")).join(c.select("id", *FIELDS), "id").select("key", *FIELDS)
    tips = state.select(F.explode("merged").alias("id")).join(c, "id").withColumn("is_root", F.size("parents") == 0)
    return merge.merge_records(tips, base, FIELDS)


@query(LOG + """, p as (select key, list_sort(list(id)) as parents, max(ts) as ts from leaves group by key having count(*) > 1)
select key, len(parents) as n_parents, parents[1] as first, parents[-1] as last, ts from p""")
def merge_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log(spark, sf_dir)
    tips = graph.leaves(c)
    made = merge.merge_commits(tips.select("key").distinct(), tips)
    return made.select("key", F.size("parents").cast("long").alias("n_parents"), F.element_at("parents", 1).alias("first"), F.element_at("parents", -1).alias("last"), "ts")


@query("with recursive " + _CORRUPT.strip().removeprefix("with ") + """,
up(id, anc, bad) as (select x.id, e.parent, y.corrupt from x join edges e on e.id = x.id join x y on y.id = e.parent where x.corrupt
  union select u.id, e.parent, y.corrupt from up u join edges e on e.id = u.anc join x y on y.id = e.parent where u.bad)
select distinct id, anc as good from up where not bad""")
def newest_good_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ancestors of each corrupt commit that aren't."""
    return records.newest_good_ancestor(records.materialise(with_records(spark, sf_dir), TYPED))


@query(_CORRUPT + """ select h.key, h.id, case when x.corrupt then good.k else x.k end as k, case when x.corrupt then good.event_type else x.event_type end as event_type
from heads h join x on x.id = h.id left join good on good.key = h.key where not h.is_deleted""")
def items_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current items as records: deltas through their base, corrupt ones from the newest good commit of their key."""
    c = with_records(spark, sf_dir)
    top = records.materialise(graph.items_current(c), TYPED, c)
    return records.with_fallback(top, records.materialise(c, TYPED)).select("key", "id", "value.k", "value.event_type")


@query()
def delta_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log(spark, sf_dir).withColumn("record", F.struct("k", "event_type", F.col("id").cast("string").alias("note")))
    fields = TYPED | {"note": ("string", "string")}
    return records.deltas(c.withColumn("is_full", F.col("rn") % 3 == 0), fields)


@query("select count(*) as n, count(distinct md5('=' || event_type || chr(31) || '=' || user_id::varchar)) as distinct_sums, min(md5('=' || event_type || chr(31) || '=' || user_id::varchar)) as least from events")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").select(checksum("event_type", "user_id").alias("c"))
    return sums.agg(F.count("*").alias("n"), F.count_distinct("c").alias("distinct_sums"), F.min("c").alias("least"))


# synchronisation


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return ev.where("id % 10 <> 3"), ev.where("id % 4 <> 1")


@query("select event_id as id from events where event_id % 10 <> 3 and event_id % 4 = 1")
def sync_missing_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = replicas(spark, sf_dir)
    return a.join(b, "id", "left_anti")


_BITS = """
with a as (select event_id as id from events where event_id % 10 <> 3), b as (select event_id as id from events where event_id % 4 <> 1),
n as (select greatest((select count(*) from a), (select count(*) from b))::double as n), f as (select n, least(0.5, pow(n, -2.0 / 3)) as fpr from n),
d as (select greatest(8, ceil(n * ln(fpr) / ln(1 / pow(2, ln(2)))))::bigint as m, n from f), s as (select m, greatest(1, ceil(m / n * ln(2)))::bigint as k from d),
bits as (select distinct ('0x' || substr(md5('1.' || i::varchar || '|' || id::varchar), 1, 15))::bigint % m as bit from b, s, range(0, 64) t(i) where i < k)
"""


@query(_BITS + """select id from a where exists (select 1 from s, range(0, 64) t(i) where i < k
  and ('0x' || substr(md5('1.' || i::varchar || '|' || a.id::varchar), 1, 15))::bigint % m not in (select bit from bits))""")
def sync_bloom_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = replicas(spark, sf_dir)
    return sync.sync_round(a, b)[0]


@query(_BITS + "select m, k, (select count(*) from bits) as bits_set from s")
def bloom_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = replicas(spark, sf_dir)
    n = max(a.count(), b.count())
    f = sync.build(b, "id", n, sync.sync_fpr(n, n, 3), 1)
    return f.bits.agg(F.lit(f.m).cast("long").alias("m"), F.lit(f.k).cast("long").alias("k"), F.count("*").alias("bits_set"))


@query("select count(*) as local_rows, count(*) as peer_rows, count(*) as both_rows from events where event_id % 10 <> 3 or event_id % 4 <> 1")
def sync_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = sync.converge(*replicas(spark, sf_dir))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a, "local_rows").join(count(b, "peer_rows")).join(count(a.intersect(b), "both_rows"))


# rich text: pages stand for bodies, each a title and paragraphs


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.struct(c.alias("text"))
    element = lambda tag, inner: F.to_json(F.struct(F.lit(tag).alias("tagName"), F.array(text(inner)).alias("children")))
    parts = F.concat_ws(",", element("h1", F.col("c_name")), element("p", F.col("c_mktsegment")), F.concat(F.lit('{"ref":"n'), F.col("c_nationkey").cast("string"), F.lit('"}')))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"children":['), parts, F.lit("]}")).alias("body"))


@query("select c_custkey, c_name || chr(10) || c_mktsegment as plain, 'n' || c_nationkey::varchar as refs, 'ltr' as direction from customer")
def rt_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir).select("c_custkey", richtext.plain_text_of("body").alias("plain"), F.array_join(richtext.refs_of("body"), ",").alias("refs"), richtext.direction_of("body").alias("direction"))


@query("select c_custkey, c_name || chr(10) || c_mktsegment || chr(10) || n_name as plain from customer join nation on n_nationkey = c_nationkey where n_nationkey <> 3 union all select c_custkey, c_name || chr(10) || c_mktsegment from customer where c_nationkey = 3")
def rt_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations take the place of their markers; one was deleted."""
    n = table(spark, sf_dir, "nation")
    tree = F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("text"))).alias("children")))
    targets = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ref"), tree.alias("body"), (F.col("n_nationkey") == 3).alias("deleted"))
    out = richtext.compose_items(bodies(spark, sf_dir).withColumnRenamed("c_custkey", "key"), targets)
    return out.select(F.col("key").alias("c_custkey"), richtext.plain_text_of("body").alias("plain"))


@query()
def rt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two leaves of each body: one appends to it, one drops its title's first letter."""
    b = bodies(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("body").alias("base"))
    first = F.regexp_replace("base", r"\]\}$", ',{"tagName":"p","children":[{"text":"more"}]}]}')
    leaf = lambda n, c: b.select("key", F.lit(n).alias("id"), F.lit(n).alias("ts"), "base", c.alias("body"))
    merged = richtext.merge_rich_text(leaf(1, first).unionByName(leaf(2, F.replace("base", F.lit('"Customer'), F.lit('"ustomer')))))
    return merged.select("key", richtext.plain_text_of("body").alias("plain"))
