"""Queries of scalar, set, date and aggregate functions, and of authorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import collections as c, scalars as s
from ..operators import authz, mutations as mut, stats, sync
from .item_queries import table
from .registry import query


@query("""select c_custkey, left(c_name, 2) || '**' || substr(c_name, 6) as spliced, 'r/' || c_name || '/' || c_mktsegment as path,
  lower(trim(c_name)) || '@mail.example.com' as email, case when c_name < c_mktsegment then -1 when c_name > c_mktsegment then 1 else 0 end as cmp, left(c_name, length(c_name) - 1) || chr(ascii(right(c_name, 1)) + 1) as succ from customer""")
def str_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    mail = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "_"), F.lit("@Mail.example.COM "))
    return t.select("c_custkey", s.splice("c_name", 2, 3, "**").alias("spliced"), s.append_path(F.lit("r"), "c_name", F.lit(None).cast("string"), "c_mktsegment").alias("path"), F.regexp_replace(s.normalize_email(mail), "_", "#").alias("email"), s.compare("c_name", "c_mktsegment").alias("cmp"), s.successor("c_name").alias("succ"))


@query("""select p_partkey, (select count(*) from range(1, 100) t(i) where i <= least(length(p_name), length(p_type)) and left(p_name, i) = left(p_type, i))::int as prefix,
  (select count(*) from range(1, 100) t(i) where i <= least(length(p_name), length(p_type)) and right(p_name, i) = right(p_type, i))::int as suffix from part""")
def str_common_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.common_prefix_length("p_name", "p_type").alias("prefix"), s.common_suffix_length("p_name", "p_type").alias("suffix"))


@query("select c_custkey, 'data' as type, c_mktsegment as repo, c_name as item, case when c_custkey % 2 = 0 then 'e' || c_nationkey::varchar end as embed from customer")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("e"), F.col("c_nationkey").cast("string")))
    made = s.append_path(F.lit("/data"), "c_mktsegment", "c_name", embed)
    return table(spark, sf_dir, "customer").select("c_custkey", s.parse_path(made).alias("p")).select("c_custkey", "p.*")


@query("""with h as (select page_id, split_part(split_part(lower(url), '/', 3), ':', 1) as host from pages)
select page_id, case when host in ('localhost', '127.0.0.1') then 'localhost' when len(string_split(host, '.')) = 3 and regexp_full_match(split_part(host, '.', 1), '[a-z0-9][a-z0-9-]*') then split_part(host, '.', 1) end as org from h""")
def org_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.org_from_url("url").alias("org"))


@query("""select o_orderkey, date_trunc('month', o_orderdate)::timestamp as month_start, (o_orderdate::date - dayofweek(o_orderdate)::int) as week_start, day(last_day(o_orderdate))::int as in_month,
  (day(last_day(o_orderdate)) - day(o_orderdate) + 1)::int as left_in_month, greatest(0, 5 - dayofweek(o_orderdate))::int as workdays_left from orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select("o_orderkey", s.start_of_month(d).alias("month_start"), s.start_of_week(d).alias("week_start"), s.days_in_month(d).alias("in_month"), s.days_left_in_month(d).alias("left_in_month"), s.workdays_left_in_week(d).alias("workdays_left"))


@query("select event_id, case when event_id % 2 = 0 then 1700000000 + event_id else 1700000000000 + event_id * 1000 end // (case when event_id % 2 = 0 then 1 else 1000 end) as secs, 9007199254740991 - event_id as reversed from events")
def date_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1700000000).otherwise(F.col("event_id") * 1000 + 1700000000000)
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(s.decode_date(raw)).alias("secs"), s.reverse_timestamp("event_id").alias("reversed"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(least(1, l_discount * 8) ** 2, 6) as quad, round((1 - cos(pi() * least(1, l_discount * 8))) / 2, 6) as sine,
  round(case when l_discount = 0 then 0 else 2 ** (10 * least(1, l_discount * 8) - 10) end, 6) as expo from lineitem""")
def easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount") * 8
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(s.ease(x, k), 6).alias(k) for k in ("quad", "sine", "expo")])


@query("select event_id, ((1 << 24) + (user_id & 255) * 65536 + 3 * 256 + event_id % 3)::int as packed, '1.' || (user_id & 255)::varchar || '.3' || case when event_id % 3 <> 0 then '-' || (event_id % 3)::varchar else '' end as shown from events")
def version_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.pack_version(F.lit(1), "user_id", F.lit(3), F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", v.alias("packed"), s.format_version(v).alias("shown"))


_SETS = """
with p as (select conv_id, list_distinct(list(role)) as a, list_distinct(list('r' || (turn % 4)::varchar) || ['user']) as b from conversations group by conv_id)"""


def two_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("conv_id")
    b = F.collect_set(F.concat(F.lit("r"), (F.col("turn") % 4).cast("string")))
    return by.agg(F.collect_set("role").alias("a"), F.array_union(b, F.array(F.lit("user"))).alias("b"))


@query(_SETS + """ select conv_id, array_to_string(list_sort(list_intersect(a, b)), ',') as both, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as less,
  array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as every, array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), ',') as either,
  list_sort(a) = list_sort(b) as same, array_to_string(list_sort(case when list_contains(a, 'system') then list_filter(a, lambda x: x <> 'system') else list_append(a, 'system') end), ',') as toggled from p""")
def set_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda x: F.array_join(x, ",")
    return two_sets(spark, sf_dir).select("conv_id", show(c.intersection("a", "b")).alias("both"), show(c.subtract("a", "b")).alias("less"), show(c.union("a", "b")).alias("every"), show(c.symmetric_difference("a", "b")).alias("either"), c.equal_sets("a", "b").alias("same"), show(c.toggle("a", F.lit("system"))).alias("toggled"))


@query("select c_custkey, arr[-1] as last, len(list_distinct(arr)) < len(arr) as repeats, 2 as n_slices from (select c_custkey, [c_name, c_mktsegment, c_name] as arr from customer)")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").withColumn("arr", F.array("c_name", "c_mktsegment", "c_name"))
    return t.select("c_custkey", c.last_value("arr").alias("last"), c.has_duplicates("arr").alias("repeats"), F.size(c.slices("arr", 2)).alias("n_slices"))


_LOGS = "with l as (select *, case event_type when 'purchase' then 'ERROR' when 'click' then 'METRIC' when 'view' then 'INFO' else 'DEBUG' end as severity from events)"


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").withColumn("severity", F.when(kind == "purchase", "ERROR").when(kind == "click", "METRIC").when(kind == "view", "INFO").otherwise("DEBUG"))


@query(_LOGS + "select event_id, case severity when 'ERROR' then 500 when 'METRIC' then 250 else 200 end as code, severity from l where severity <> 'DEBUG'")
def log_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = log_entries(spark, sf_dir).withColumn("code", s.severity_code("severity")).where("code >= 200")
    return t.select("event_id", "code", s.severity_name("code").alias("severity"))


@query("""with n as (select max(ts) as now from events), u as (select user_id, max(ts) as last, count(*) as n from events where user_id % 10 <> 0 group by user_id)
select count(*) filter (last >= now - interval 1 day) as dau, count(*) filter (last >= now - interval 7 day) as wau, count(*) filter (last >= now - interval 30 day) as mau, sum(n)::bigint as scan_size from u, n""")
def activity_dau_wau_mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    now = F.lit(ev.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return stats.activity(ev, now, excluded=ev.select("user_id").where("user_id % 10 = 0").distinct())


@query("select event_type, count(*) as n, round(sum(value), 4) as total, arg_max(value, event_id) as latest, min(value) as low, max(value) as high from events group by event_type")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.metric_rollup(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id").drop("quantiles").withColumn("total", F.round("total", 4))


@query("select event_type, le, count(*) filter (value <= le) as n from events, (values (10.0::double), (50.0::double), (100.0::double)) t(le) group by event_type, le")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [10, 50, 100])


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between 4 preceding and current row), 6) as moving_average from events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.moving_average(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 5)
    return out.select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted_average from lineitem group by l_returnflag")
def weighted_avg_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.weighted_average(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.withColumn("weighted_average", F.round("weighted_average", 4))


@query("""select o_orderkey, case when o_custkey % 50 = 0 then false when o_custkey % 50 = 1 then true when o_orderkey % 10 = 9 then o_custkey = o_orderkey // 10
  when c_mktsegment = 'BUILDING' then true else o_custkey % 3 = o_orderkey % 3 end as allowed from orders join customer on c_custkey = o_custkey""")
def authz_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for the workspaces of orders; those of one segment are operators."""
    o, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    who = F.when(F.col("o_custkey") % 50 == 1, "root").when(F.col("o_custkey") % 50 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    personal = F.concat(F.lit("u"), F.floor(F.col("o_orderkey") / 10).cast("string"), F.lit(authz.PERSONAL_SUFFIX))
    ws = F.when(F.col("o_orderkey") % 10 == 9, personal).otherwise(F.concat(F.lit("w"), F.col("o_orderkey").cast("string")))
    asked = o.select("o_orderkey", "o_custkey", who.alias("user"), ws.alias("workspace"))
    member = F.when(F.col("o_custkey") % 3 == F.col("o_orderkey") % 3, F.array(F.concat(F.lit("u"), F.col("o_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    spaces = o.where("o_orderkey % 10 <> 9").select(ws.alias("workspace"), member.alias("users"))
    users = cust.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), F.when(F.col("c_mktsegment") == "BUILDING", "op@example.com").otherwise("no@example.com").alias("email"), F.array().cast("array<string>").alias("permissions"))
    return authz.workspace_allows(asked, spaces, users, ["op@example.com"]).select("o_orderkey", "allowed")


@query("""with h as (select c_custkey, c_name, hex(encode(c_name)) as h, length(c_name) as n from customer),
b as (select c_custkey, c_name, n, rpad(h, (ceil(n / 5) * 10)::int, '0') as h from h),
d as (select c_custkey, c_name, n, array_to_string(list_transform(range(0, ceil(n / 5)::bigint), lambda i: to_base(('0x' || substr(h, (i * 10 + 1)::bigint, 10))::bigint, 32, 8)), '') as t from b)
select c_custkey, regexp_replace(rpad(translate(left(t, ceil(n * 8 / 5)::bigint), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'abcdefghijklmnopqrstuvwxyz234567'), (ceil(n / 5) * 8)::int, '='), '=', '_') as coded, c_name as back from d""")
def base32(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", s.encode_base32("c_name").alias("coded"))
    return t.withColumn("back", s.decode_base32("coded").cast("string"))


@query("""with e as (select user_id, event_id, event_type as field, event_id % 3 <> 0 as local, event_id::varchar as old from events),
f as (select user_id, field, min(event_id) as seq, arg_min(local, event_id) as local, arg_min(old, event_id) as old from e group by user_id, field)
select user_id, count(*)::int as n, arg_min(field, seq) as first_field, arg_min(old, seq) as first_old, bool_or(not local) as remote, bool_or(field = 'purchase') as bought,
  coalesce(string_agg(field, ',' order by seq) filter (field <> 'view'), '') as rest from f group by user_id""")
def mutation_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mutation of each field of a user, where events stand for mutations."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("field"), (F.col("event_id") % 3 != 0).alias("local"), F.col("event_id").cast("string").alias("old"))
    packs = mut.collect(ev, "user_id", "event_id")
    view = F.array(mut.mutation("view", F.lit(True), F.lit("")))
    rest = mut.subtract_fields("pack", view)
    return packs.select("user_id", mut.length("pack").alias("n"), mut.at("pack", 0)["field"].alias("first_field"), mut.at("pack", 0)["old"].alias("first_old"), mut.has_remote("pack").alias("remote"), mut.has_field("pack", "purchase").alias("bought"), F.array_join(F.transform(rest, lambda m: m["field"]), ",").alias("rest"))


@query("""with a as (select c_custkey, c_nationkey % 3 as x, c_custkey % 2 as y from customer)
select c_custkey, x = 1 and y = 0 as has, case when x = 1 and y = 0 then 2 else 3 end as added, case when x = 1 and y = 0 then 1 else 2 end as deleted, x = 1 and y = 0 as same from a""")
def sets_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of objects, whose members are equal whatever the order of their keys."""
    x, y = (F.col("c_nationkey") % 3).cast("string"), (F.col("c_custkey") % 2).cast("string")
    one = F.concat(F.lit('{"x": '), x, F.lit(', "y": '), y, F.lit("}"))
    turned = F.concat(F.lit('{"y":'), y, F.lit(',"x":'), x, F.lit("}"))
    t = table(spark, sf_dir, "customer").select("c_custkey", F.array(one, turned, F.lit("7")).alias("a"))
    probe, other = F.lit('{ "y" : 0, "x" : 1 }'), F.array(F.lit("7"), F.lit('{"x":1,"y":0}'))
    return t.select("c_custkey", c.has_by_value("a", probe).alias("has"), F.size(c.add_by_value("a", probe)).alias("added"), F.size(c.delete_by_value("a", probe)).alias("deleted"), c.equal_by_value("a", other).alias("same"))


@query("""with v as (select event_type, value from events where value is not null),
q as (select event_type, p, value, cume_dist() over (partition by event_type order by value) as share from v, (values (0.5), (0.9), (0.99)) t(p))
select event_type, p::double as p, min(value) as quantile from q where share >= p group by event_type, p""")
def metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = stats.metric_rollup(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    ps = F.array(*[F.lit(float(p)) for p in stats.QUANTILES])
    return rolled.select("event_type", F.explode(F.arrays_zip(ps.alias("p"), "quantiles")).alias("z")).select("event_type", F.col("z.p").alias("p"), F.col("z.quantiles").alias("quantile"))


@query("""with a as (select c_custkey as id from customer where c_custkey % 5 = 0), b as (select c_custkey as id from customer where c_custkey % 5 <> 0),
n as (select count(*)::double as n from a), d as (select greatest(8, ceil(n * ln(0.05) / ln(1 / pow(2, ln(2)))))::bigint as m, n from n), s as (select m, greatest(1, ceil(m / n * ln(2)))::bigint as k from d),
bits as (select distinct ('0x' || substr(md5('3.' || i::varchar || '|' || id::varchar), 1, 15))::bigint % m as bit from a, s, range(0, 64) t(i) where i < k),
miss as (select distinct b.id from b, s, range(0, 64) t(i) where i < k and ('0x' || substr(md5('3.' || i::varchar || '|' || b.id::varchar), 1, 15))::bigint % m not in (select bit from bits))
select (select count(*) from b) as tested, (select count(*) from b) - (select count(*) from miss) as passed""")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the keys that aren't in a filter pass it."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    known, others = keys.where("id % 5 = 0"), keys.where("id % 5 <> 0")
    f = sync.build(known, "id", known.count(), 0.05, 3)
    passed = sync.may_contain(others, "id", f).withColumn("hit", F.lit(1))
    return others.join(passed, "id", "left").agg(F.count("*").alias("tested"), F.count("hit").alias("passed"))
