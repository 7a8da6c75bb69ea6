"""Queries of the version graph over the synthetic commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..operators import graph, query as q
from ..sources.log import dedupe_with_age
from .registry import LOG, query
from .synthetic import synthetic_commits as log



def middle(spark: SparkSession, sf_dir: str) -> object:
    """A point in time inside the log: the time of its middle event id."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = ev.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return F.lit(ev.where(F.col("event_id") >= half).agg(F.min_by("ts", "event_id")).first()[0]).cast("timestamp_ntz")


_MID = "(select min_by(ts, event_id) from events where event_id >= (select max(event_id) // 2 from events))"


@query(LOG + "select id, parent, key from edges")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(log(spark, sf_dir))


@query(LOG + "select id, key from leaves_raw")
def leaves_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leaves_raw(log(spark, sf_dir)).select("id", "key")


@query(LOG + "select id, key, connection from leaves")
def leaves_by_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leaves(log(spark, sf_dir)).select("id", "key", "connection")


@query(LOG + "select id, key, connection, age from heads")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heads(log(spark, sf_dir)).select("id", "key", "connection", "age")


@query(LOG + "select id, key from leaves qualify row_number() over (partition by key order by case when connection = 'click' then 2 when session = 3 then 1 else 0 end desc, ts desc, id desc) = 1")
def heads_preferred_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heads(log(spark, sf_dir), connection="click", session=3).select("id", "key")


@query(LOG + "select id, key, value, k, event_type, scheme_version from items")
def items_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.items_current(log(spark, sf_dir)).select("id", "key", "value", "k", "event_type", "scheme_version")


@query("select event_id as id, row_number() over (order by event_id) as age from events")
def log_dedupe_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a third of the commits arrived twice."""
    c = log(spark, sf_dir).select("id").withColumn("pos", F.col("id"))
    again = c.where("id % 3 = 0").withColumn("pos", F.col("id") + F.lit(1 << 40))
    return dedupe_with_age(c.unionByName(again), ["pos"]).select("id", "age")


@query(LOG + "select key, max(age) as max_age, count(*) as commits from commits group by key")
def age_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("key").agg(F.max("age").alias("max_age"), F.count("*").alias("commits"))


@query(LOG + f"select id, key from commits where ts <= {_MID} qualify row_number() over (partition by key order by ts desc, id desc) = 1")
def as_of_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.as_of(log(spark, sf_dir), middle(spark, sf_dir)).select("id", "key")


@query(LOG + f"select id, key from commits where ts < {_MID} and session in (1, 2, 3) qualify row_number() over (partition by key order by ts desc, id desc) = 1")
def before_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.before(log(spark, sf_dir), middle(spark, sf_dir), [1, 2, 3]).select("id", "key")


@query(LOG + "select id, key from commits where value > 50 qualify row_number() over (partition by key order by ts desc, id desc) = 1")
def latest_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_matching(log(spark, sf_dir), F.col("value") > 50).select("id", "key")


@query("with recursive " + LOG.strip().removeprefix("with ") + """,
bad as (select id from heads where connection = 'click'),
reach(id, anc) as (select e.id, e.parent from edges e join bad on bad.id = e.id union select r.id, e.parent from reach r join edges e on e.id = r.anc),
back as (select r.id as head, c.id, c.key from reach r join commits c on c.id = r.anc where c.connection <> 'click' qualify row_number() over (partition by r.id order by c.ts desc, c.id desc) = 1)
select id, key from back union all select id, key from heads where id not in (select head from back)""")
def revert_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads by one connection go back to their newest ancestor by another."""
    return graph.revert_connection(log(spark, sf_dir), ["click"]).select("id", "key")


@query(LOG + "select id, key from commits qualify row_number() over (partition by key, session order by ts desc, id desc) = 1")
def newest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.newest_per(log(spark, sf_dir), "key", "session").select("id", "key")


@query(LOG + ", part as (select * from commits where id % 5 <> 0) select e.id, e.parent from (select id, unnest(parents) as parent from part) e where e.parent not in (select id from part)")
def orphans_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(log(spark, sf_dir).where("id % 5 <> 0")).select("id", "parent")


@query(LOG + ", part as (select * from commits where id % 5 <> 0) select id, false as missing from part union all select distinct e.parent, true from (select unnest(parents) as parent from part) e where e.parent not in (select id from part)")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_export(log(spark, sf_dir).where("id % 5 <> 0"))[0]


@query(LOG + "select id, key from commits where base is null or base in (select id from commits where base is null)")
def readable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.readable(log(spark, sf_dir)).select("id", "key")




@query("with recursive " + LOG.strip().removeprefix("with ") + """,
reach(id, anc, depth) as (select e.id, e.parent, 1 from edges e join heads h on h.id = e.id
  union select r.id, e.parent, r.depth + 1 from reach r join edges e on e.id = r.anc)
select id, anc, min(depth)::int as depth from reach group by id, anc""")
def ancestors_of_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log(spark, sf_dir)
    return graph.ancestors(c, graph.heads(c).select("id"))


@query("with recursive " + LOG.strip().removeprefix("with ") + """,
r2 as (select key, id, row_number() over (partition by key order by ts desc, id desc) as n from leaves),
pairs as (select x.id as a, y.id as b from r2 x join r2 y on x.key = y.key and x.n = 1 and y.n = 2),
reach(id, anc, depth) as (select e.id, e.parent, 1 from edges e where e.id in (select a from pairs union select b from pairs)
  union select r.id, e.parent, r.depth + 1 from reach r join edges e on e.id = r.anc),
low as (select id, anc, min(depth) as depth from reach group by id, anc),
good as (select id from commits where base is null or base in (select id from commits where base is null)),
best as (select a, b, l.anc from pairs join low l on l.id = a join low m on m.id = b and m.anc = l.anc join good g on g.id = l.anc
  qualify row_number() over (partition by a, b order by greatest(l.depth, m.depth), l.anc desc) = 1)
select p.a, p.b, case when len(ca.parents) = 0 or len(cb.parents) = 0 then null when list_contains(ca.parents, p.b) then p.b
  when list_contains(cb.parents, p.a) then p.a else best.anc end as lca
from pairs p join commits ca on ca.id = p.a join commits cb on cb.id = p.b left join best on best.a = p.a and best.b = p.b""")
def lca_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest leaves of each key."""
    c = log(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))
    ranked = graph.leaves(c).select("key", "id", n.alias("n")).where("n <= 2")
    pairs = ranked.groupBy("key").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("b"))
    return graph.lca_pairs(c, pairs.where("b is not null").select("a", "b")).select("a", "b", "lca")


_PART = """, part as (select * from commits where not (base is null and id % 4 = 0)), full_ids as (select id from part where base is null),
ok as (select * from part where base is null or base in (select id from full_ids)), named as (select unnest(parents) as parent from part),
lv as (select * from ok where id not in (select parent from named) qualify row_number() over (partition by key, connection order by ts desc, id desc) = 1),
top as (select * from lv qualify row_number() over (partition by key order by ts desc, id desc) = 1)"""


def part_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that a quarter of the full commits has not reached, so that some leaves can't be read."""
    return log(spark, sf_dir).where("not (base is null and id % 4 = 0)")


@query(LOG + _PART + " select id, key, connection from lv")
def leaves_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leaves(part_of_log(spark, sf_dir)).select("id", "key", "connection")


@query(LOG + _PART + """, back as (select * from ok where key not in (select key from top) qualify row_number() over (partition by key order by ts desc, id desc) = 1)
select id, key from top union all select id, key from back""")
def heads_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose leaves can't be read have the best of their readable commits."""
    return graph.heads(part_of_log(spark, sf_dir)).select("id", "key")


def two_newest_leaves(c: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))
    return graph.leaves(c).withColumn("n", n).where("n <= 2")


_TWO = LOG.strip().removeprefix("with ") + """,
r2 as (select *, row_number() over (partition by key order by ts desc, id desc) as n from leaves),
pairs as (select x.key, y.id as a, x.id as b from r2 x join r2 y on x.key = y.key and x.n = 1 and y.n = 2),
reach(id, anc, depth) as (select e.id, e.parent, 1 from edges e where e.id in (select a from pairs union select b from pairs)
  union select r.id, e.parent, r.depth + 1 from reach r join edges e on e.id = r.anc),
low as (select id, anc, min(depth) as depth from reach group by id, anc),
best as (select a, b, l.anc from pairs join low l on l.id = a join low m on m.id = b and m.anc = l.anc
  qualify row_number() over (partition by a, b order by greatest(l.depth, m.depth), l.anc desc) = 1),
lca as (select p.key, p.a, p.b, case when len(ca.parents) = 0 or len(cb.parents) = 0 then null when list_contains(ca.parents, p.b) then p.b
    when list_contains(cb.parents, p.a) then p.a else best.anc end as lca
  from pairs p join commits ca on ca.id = p.a join commits cb on cb.id = p.b left join best on best.a = p.a and best.b = p.b)"""


@query("with recursive " + _TWO + """ select key, coalesce(lca, a) as base, case when lca is null then 1 else 2 end as merged, case when lca is null then 1 else 0 end as unmerged from lca
union all select key, id, 1, 0 from r2 where key not in (select key from pairs)""")
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest leaves of each key, folded from the older one."""
    c = log(spark, sf_dir)
    found = graph.merge_bases(c, two_newest_leaves(c))
    return found.select("key", "base", F.size("merged").alias("merged"), F.size("unmerged").alias("unmerged"))


@query(LOG + """, r2 as (select *, row_number() over (partition by key order by ts desc, id desc) as n from leaves),
pairs as (select x.key, x.id as a, y.id as b, least(x.ts, y.ts) as least_ts, x.session as sa, y.session as sb from r2 x join r2 y on x.key = y.key and x.n = 1 and y.n = 2),
met as (select a, b, c.id from pairs p join commits c on c.key = p.key and c.ts < least_ts and c.session in (sa, sb) qualify row_number() over (partition by a, b order by c.ts desc, c.id desc) = 1)
select p.a, p.b, met.id as base from pairs p left join met on met.a = p.a and met.b = p.b""")
def as_of_pair_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log(spark, sf_dir)
    pairs = two_newest_leaves(c).groupBy("key").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("b"))
    return graph.as_of_pair_base(c, pairs.where("b is not null").select("a", "b"))


@query("with recursive " + LOG.strip().removeprefix("with ") + """, start as (select min(id) as id from commits),
below(id) as (select e.id from edges e, start where e.parent = start.id union select e.id from below b join edges e on e.parent = b.id) select id from below""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits below the first one."""
    c = log(spark, sf_dir)
    return graph.descendants(c, c.agg(F.min("id")).first()[0])


@query("with recursive " + LOG.strip().removeprefix("with ") + """,
walk(id, depth) as (select id, 0 from commits where len(parents) = 0 union select e.id, w.depth + 1 from walk w join edges e on e.parent = w.id)
select id, min(depth)::int as depth from walk group by id""")
def forest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forest(log(spark, sf_dir))


@query(LOG + """, recent as (select id, key, event_type || '|' || (k % 3)::varchar as checksum, ts from commits)
select id, key from recent qualify row_number() over (partition by key, checksum order by ts desc, id desc) = 1""")
def unique_by_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("checksum", F.concat_ws("|", "event_type", (F.col("k") % 3).cast("string")))
    return graph.unique_by_checksum(rows).select("id", "key")


@query("select c_custkey, arg_min(r_name, md5(r_name || '|' || c_custkey::varchar)) as r_name from customer, region group by c_custkey")
def rendezvous_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return graph.rendezvous(t("customer"), t("region"), "c_custkey", "r_name")


@query(LOG + ", s as (select distinct key, k % 5 as session from commits) select key, arg_min(session, md5(session::varchar || '|' || key::varchar)) as leader from s group by key")
def merge_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_leader(log(spark, sf_dir).withColumn("session", F.col("k") % 5))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heads(log(spark, sf_dir)).withColumn("scheme_ns", F.when(F.col("key") % 2 == 0, "note").otherwise("task"))


def flagship_query(spark: SparkSession, sf_dir: str) -> q.Query:
    return q.Query(items(spark, sf_dir), scheme="note", predicate=lambda ctx: F.col("value") > ctx["least"], sort=[F.desc("value")], ctx={"least": 20}, name="log")


@query(LOG + "select key, id, value, event_type from items where key % 2 = 0 and value > 20 order by value desc, key")
def query_scheme_predicate_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_query(spark, sf_dir).results().select("key", "id", "value", "event_type")


@query("select doc_id as key, n_chars from documents where starts_with(text, 'The') order by n_chars desc, doc_id")
def query_prefix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "key")
    return q.Query(docs, predicate=lambda ctx: F.col("text").startswith(ctx["prefix"]), sort=[F.desc("n_chars")], ctx={"prefix": "The"}).results().select("key", "n_chars")


@query(LOG + "select key, value from items where key % 2 = 0 and value > 20 and k % 2 = 1 order by value, key")
def query_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_query(spark, sf_dir).chain(predicate=F.col("k") % 2 == 1, sort=[F.col("value")]).results().select("key", "value")


@query(LOG + "select count(*) as n from items where key % 2 = 0 and value > 20")
def query_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_query(spark, sf_dir).members().agg(F.count("*").alias("n"))


@query("select c_custkey as key, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000) as member from customer")
def query_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    dear = q.Query(t("orders").withColumnRenamed("o_custkey", "key"), predicate=F.col("o_totalprice") > 100000, name="orders")
    return dear.membership(t("customer").select(F.col("c_custkey").alias("key")))


@query(LOG + "select key, id, value, event_type from items order by value desc, key limit 20")
def query_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.Query(items(spark, sf_dir), sort=[F.desc("value")]).top(20).select("key", "id", "value", "event_type")


_OLD = LOG.replace("from events window", "from (select * from events where event_id < (select max(event_id) // 2 from events)) window")


def old_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Heads of the first half of the log, as if it ended there, and its last age."""
    c = log(spark, sf_dir)
    half = c.agg(F.floor(F.max("id") / 2)).first()[0]
    old = graph.heads(c.where(F.col("id") < half)).withColumn("scheme_ns", F.when(F.col("key") % 2 == 0, "note").otherwise("task"))
    return old, half


@query(LOG + "select key from items where key % 2 = 0 and value > 20")
def incremental_changes_since_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the result cached at half of the log, only keys changed since are tested; the result is that of a full run."""
    now = flagship_query(spark, sf_dir)
    old, age = old_items(spark, sf_dir)
    before = q.Query(old, now.scheme, now.predicate, now.sort, now.ctx)
    return q.refresh(now, before.keys(), age)


@query(LOG.strip() + ", old as (with x as (" + _OLD.strip() + """ select * from items) select key, id from x where key % 2 = 0 and value > 20),
new as (select key, id from items where key % 2 = 0 and value > 20)
select coalesce(o.key, n.key) as key, case when o.key is null then 'added' when n.key is null then 'removed' else 'updated' end as change
from old o full join new n on o.key = n.key where o.id is distinct from n.id""")
def result_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = flagship_query(spark, sf_dir)
    old, _ = old_items(spark, sf_dir)
    before = q.Query(old, now.scheme, now.predicate, now.sort, now.ctx)
    return q.result_delta(before.members(), now.members(), "id")
