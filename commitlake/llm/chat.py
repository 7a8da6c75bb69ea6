"""Chat formatting of reply trees, in DataFrame operations only.

Messages are nodes with a parent.  Iterative self-joins by pointer doubling give every node its root and the score of
its path in log2(depth) rounds; leaves are ranked within a root by path score (ties: smaller node), and the nodes of
each chosen root-to-leaf path are enumerated by the same jumps, so only chosen paths are ever expanded.  Joins are on
the unique node id, never on the conversation.  One conversation becomes one output row, which holds its whole text;
``linear_tree``, which links turns in order, sorts the turns of one conversation in one task, without their texts.

Template: ``### Role: text</turn>\\n`` for each turn.  Inside texts a backslash becomes ``\\b``, ``### `` becomes
``\\h## `` and ``</turn>`` becomes ``\\l/turn>``: every backslash starts an escape, so three plain replacements read
it back.  ``loss_mask`` has an element for each turn, true for assistant turns: the text of the turn, without markers.

Defined results: null text and null role are empty; a null conversation id is a conversation of its own; turns that
tie are ordered by role, then by the md5 of the text, and repeated rows all stay; very long texts are formatted whole, up
to Spark's limit of 2 GiB a row; a parent that doesn't exist makes its child a root; messages on a cycle have no root and
are left out; an empty table gives an empty result; extra columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from .common import durable, table

END = "</turn>"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("### "), F.lit("\\h## ")), F.lit(END), F.lit("\\l/turn>"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, shown in ROLES.items():
        known = F.when(role == name, F.lit(shown)).otherwise(known)
    other = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    return F.concat(F.lit("### "), F.coalesce(known, other), F.lit(": "))


def _role(head: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, shown in ROLES.items():
        known = F.when(head == shown, F.lit(name)).otherwise(known)
    return F.coalesce(known, unescape(F.replace(F.substring(head, 2, 1 << 30), F.lit("\\c"), F.lit(":"))))


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """nodes (node long unique, parent long, score double) -> (path, node, up): chosen paths, ``up`` 0 at the leaf."""
    ids = nodes.select(F.col("node").alias("__id"))
    real = nodes.select("node", "parent", "score").join(ids, F.col("parent") == F.col("__id"), "left")
    start = durable(real.select("node", F.col("__id").alias("jump"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.when(F.col("__id").isNull(), F.col("node")).alias("root")), "chat-jumps")
    # nodes that know their root leave the probing side, so a round works on what is deeper than it has reached
    acc, below = start.where("jump is null"), start.where("jump is not null")
    levels, before = [], -1
    while (open_now := below.count()) and open_now != before:
        levels.append(below.select("node", "jump"))
        before = open_now
        other = acc.unionByName(below).select(F.col("node").alias("__n"), F.col("jump").alias("__j"), F.col("total").alias("__t"), F.col("root").alias("__r"))
        step = below.join(other, below["jump"] == other["__n"], "left")
        step = durable(step.select("node", F.col("__j").alias("jump"), (F.col("total") + F.coalesce("__t", F.lit(0.0))).alias("total"), F.coalesce("root", "__r").alias("root")), "chat-jumps")
        acc, below = acc.unionByName(step.where("jump is null")), step.where("jump is not null")
    parents = nodes.select(F.col("parent").alias("__p")).where("__p is not null").distinct()
    leaves = acc.where("root is not null").join(parents, F.col("node") == F.col("__p"), "left_anti")
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("total"), "node"))
    paths = durable(leaves.withColumn("rank", rank).where(f"rank <= {int(top)}").select(F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    for k in reversed(range(len(levels))):
        jump = levels[k].withColumnRenamed("node", "__n")
        more = paths.join(jump, paths["node"] == jump["__n"]).select("path", F.col("jump").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = durable(paths.unionByName(more), "chat-paths")
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """messages (node, conv_id, role, text) on chosen paths -> (conv_id, path, formatted, loss_mask)."""
    lines = paths.join(messages, "node").select("path", "conv_id", "up", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(_head(F.col("role")), escape(F.col("text")), F.lit(END + "\n")).alias("line"), (F.col("role") == "assistant").alias("loss"))
    chat = lines.groupBy("path").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return chat.select("conv_id", "path", F.array_join("turns.line", "").alias("formatted"), F.col("turns.loss").alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Parse formatted conversations: (conv_id, path, turns array<(role, text, loss)>, formatted)."""
    parts = F.filter(F.split("formatted", END + "\n", -1), lambda s: s != "")
    head = lambda s: F.regexp_extract(s, r"^### ([^:]*): ", 1)
    text = lambda s: unescape(F.substring(s, F.lit(7) + F.length(head(s)), F.lit(1 << 30)))
    turns = F.zip_with(parts, "loss_mask", lambda s, m: F.struct(_role(head(s)).alias("role"), text(s).alias("text"), m.alias("loss")))
    return chats.select("conv_id", "path", turns.alias("turns"), "formatted")


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each message answers the one before it."""
    rows = durable(conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("node")), "chat-rows")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")), "node")
    links = rows.select("node", F.lag("node").over(order).alias("parent"), F.lit(0.0).alias("score"))
    return rows, links


def format_conversations(conversations: DataFrame) -> DataFrame:
    rows, links = linear_tree(conversations)
    return format_paths(rows.select("node", "conv_id", "role", "text"), reply_paths(links))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    chats = durable(format_conversations(own.unionByName(planted)), "chat-out")
    back = read_back(chats)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESC = r"replace(replace(replace(t, '\', '\b'), '### ', '\h## '), '</turn>', '\l/turn>')"
OP4_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id::bigint as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, md5(t))) as turns_sha256,
  coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, role, md5(t)) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + case when role in ('user', 'assistant', 'system') then 0 else 1 end + 2 + length({_ESC}) + 8)::bigint as formatted_chars
from c group by conv_id
"""
