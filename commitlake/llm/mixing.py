"""Mixing sources to target weights.

Every document gets a hash-random key, of its id and text; within its source the keys are range-sorted, distributed prefix sums of word
counts run over them, and each source is cut at its exact budget, after as many whole epochs as the budget holds.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; no target exceeds
``max_repeat`` times its source's size, and the excess is shared again by weight until none does.

Defined results: null texts and texts without words have size 0 and take 0; a null source is a source of its own;
repeated rows are separate rows, and rows of one id are keyed by their texts, so that no id is one task's work; ties of
the key are rows equal in both; a very long text is counted whole, and cut like any other if the budget ends in it; an
empty table gives an empty result; extra columns of any name pass through, but for names that start with ``__mix_``.  ``mix_documents`` repeats a document once per epoch, drops what the mix doesn't take, and cuts the one
document of a source in which the budget ends after a whole word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from .common import durable, join_small, reserve, split_running, table

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def word_count(text: str):
    """Words of a text: where a word starts, found by codegen'd string functions of the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> also target double.  Sources are ranked by window over one row per source.

    Water filling in closed form: by ascending ratio of cap to weight, the first k sources are capped where the level
    left for the rest does not reach the next ratio.
    """
    pick = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("__i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("__w", F.element_at(pick, (F.col("__i") % len(weights) + 1).cast("int")).cast("long")).withColumn("__cap", F.col("source_size") * max_repeat)
    order = W.orderBy((F.col("__cap").cast("double") / F.col("__w")), "__i")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = named.select("*", (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0))).alias("__left"), (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))).alias("__wl"))
    level = level.withColumn("__capped", F.col("__left") * F.col("__w") > F.col("__cap") * F.col("__wl"))
    # capped sources come first in this order; the level of the first uncapped source holds for all of them
    first = level.withColumn("__l", F.min(F.when(~F.col("__capped"), F.struct(F.row_number().over(order).alias("r"), F.col("__left").alias("l"), F.col("__wl").alias("w")))).over(every))
    target = F.when(F.col("__capped") | F.col("__l").isNull(), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__l.l").cast("double") / F.col("__l.w").cast("double"))
    return first.select("source", "source_size", target.alias("target"))


def take(rows: DataFrame, seed: str = "mix", max_repeat: int = 3) -> DataFrame:
    """Narrow stable rows (doc_id, source, size, md5 of the text ``__d``) plus source_size, target, epochs, rest, taken."""
    goals = durable(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat=max_repeat), "mix-targets")
    # 15 hex digits of md5 fit a non-negative long: the same order in any SQL engine
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__d").cast("binary"))
    keyed = rows.withColumn("__h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") * 8)
    summed = split_running(keyed, "source", ["__h", "doc_id", "__d"], "size", "__before")
    out = join_small(summed, goals, ["source"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("__before"))).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", rest)
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long")).drop("__h", "__before")


def mix_documents(docs: DataFrame, seed: str = "mix", max_repeat: int = 3) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each time that a document is taken."""
    reserve(docs, "__mix_row", "__mix_size", "__mix_epochs", "__mix_rest", "__mix_copy")
    kept = durable(docs.withColumn("__mix_row", F.monotonically_increasing_id()).withColumn("__mix_size", word_count("text")), "mix-rows")
    plan = take(kept.select("__mix_row", "doc_id", "source", F.col("__mix_size").alias("size"), text_digest().alias("__d")), seed, max_repeat)
    plan = durable(plan.where("epochs > 0 or rest > 0").select("__mix_row", F.col("epochs").alias("__mix_epochs"), F.col("rest").alias("__mix_rest")), "mix-plan")
    # a document without words is taken once with each whole epoch: size 0 costs nothing
    joined = kept.join(plan.hint("shuffle_hash"), "__mix_row")
    copies = joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), (F.col("__mix_epochs") + F.when(F.col("__mix_rest") > 0, 1).otherwise(0)).cast("int"))))
    partial = (F.col("__mix_copy") > F.col("__mix_epochs")) & (F.col("__mix_rest") < F.col("__mix_size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD}[{SPACE}]*)"), F.lit(1)), 1, F.greatest(F.lit(1), F.col("__mix_rest").cast("int"))), "")
    cut = copies.withColumn("text", F.when(partial, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(partial, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = durable(docs.select("doc_id", "source", word_count("text").alias("size"), text_digest().alias("__d")), "mix-narrow")
    return take(rows).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
with recursive d as (
  select doc_id, source, md5(coalesce(text, '')) as __d, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w from s),
r(step, source, source_size, w, capped, target) as (
  select 0, source, source_size, w, false, 0::double from n
  union all
  select step + 1, source, source_size, w,
    capped or lft * w > 3 * source_size * wl,
    case when capped or lft * w > 3 * source_size * wl then (3 * source_size)::double
         else w * lft::double / wl::double end
  from (select *,
      (sum(source_size) over () - sum(case when capped then 3 * source_size else 0 end) over ())::bigint as lft,
      greatest(1, sum(case when capped then 0 else w end) over ())::bigint as wl
    from r where step < 40)),
g as (select source, source_size, target from r where step = 40),
k as (select d.*, g.source_size, g.target,
    coalesce(sum(size) over (partition by d.source
      order by substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || __d), 1, 15), doc_id, __d
      rows between unbounded preceding and 1 preceding), 0)::bigint as prior
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then floor(target)::bigint // source_size else 0 end * size
   + greatest(0, least(size, floor(target)::bigint
     - (case when source_size > 0 then floor(target)::bigint // source_size else 0 end) * source_size - prior)))::bigint as taken
from k
"""
