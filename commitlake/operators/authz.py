"""Row-level authorisation and trust, as filters and joins.

``users`` (user, email, permissions array) and ``workspaces`` (workspace, users array) are dimension tables; they are
joined on their keys and left to the optimiser, which broadcasts them if they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

PERSONAL_SUFFIX = "-personal"


def operators_of(users: DataFrame, operator_emails: list[str]) -> DataFrame:
    return users.where(F.col("email").isin(operator_emails)).select("user")


def directory_allows(requests: DataFrame, users: DataFrame, operator_emails: list[str]) -> DataFrame:
    """requests (user, key, namespace, exists, members array, own_session boolean, write, changed array) -> + allowed."""
    who = users.select(F.col("user"), F.col("email").alias("_mail"), F.col("permissions").alias("_perm"), F.lit(True).alias("_known"))
    r = requests.join(who, "user", "left")
    operator = F.coalesce(F.col("_mail").isin(operator_emails), F.lit(False))
    member = F.coalesce(F.array_contains("members", F.col("user")), F.lit(False))
    manager = F.coalesce(F.array_contains("_perm", F.lit("manage:users")), F.lit(False))
    protected = F.col("changed").isNull() | F.arrays_overlap("changed", F.array(F.lit("email"), F.lit("permissions")))
    workspace = F.when(operator, True).when(~F.col("exists"), F.col("write")).otherwise(member)
    person = F.when(operator, True).when(F.col("_known").isNull(), False).when(manager, True).when(~F.col("exists"), False).when(F.col("user") == F.col("key"), ~F.col("write") | ~protected).otherwise(~F.col("write"))
    by_kind = F.when(F.col("namespace") == "workspaces", workspace).when(F.col("namespace") == "users", person).when(F.col("namespace") == "sessions", ~F.col("write")).otherwise(False)
    allowed = F.when(F.col("user").isNull(), ~F.col("write") & F.col("own_session")).when(F.col("user") == "root", True).otherwise(by_kind)
    return r.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("_mail", "_perm", "_known")


def workspace_allows(requests: DataFrame, workspaces: DataFrame, users: DataFrame, operator_emails: list[str]) -> DataFrame:
    """requests (user, workspace) -> + allowed: root, the owner of a personal workspace, operators and members."""
    ops = operators_of(users, operator_emails).withColumn("_op", F.lit(True))
    ws = workspaces.select("workspace", F.col("users").alias("_members"))
    r = requests.join(ops, "user", "left").join(ws, "workspace", "left")
    personal = F.col("workspace").endswith(PERSONAL_SUFFIX)
    owner = F.col("user") == F.expr(f"left(workspace, length(workspace) - {len(PERSONAL_SUFFIX)})")
    allowed = F.when(F.col("user").isNull(), False).when(F.col("user") == "root", True).when(personal, owner).when(F.col("_op"), True).otherwise(F.array_contains("_members", F.col("user")))
    return r.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("_op", "_members")


def user_allows(user: Column, repo_user: Column) -> Column:
    return F.coalesce((user == "root") | (user == repo_user), F.lit(False))


def visible(commits: DataFrame, keys: DataFrame) -> DataFrame:
    """Commits of the keys that a session may read."""
    return commits.join(keys.select("key").distinct(), "key", "left_semi")


def trusted_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session: the latest expiry, and of equals one with an owner."""
    order = [F.desc("expiration"), F.col("owner").isNotNull().desc(), "owner"]
    return sessions.withColumn("_r", F.row_number().over(W.partitionBy("session").orderBy(*order))).where("_r = 1").drop("_r")


def unexpired_roots(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where((F.col("owner") == "root") & (F.col("expiration") > now))


def request_in_window(ts: Column, now: Column, minutes: int = 3) -> Column:
    return F.abs(F.unix_micros(ts) - F.unix_micros(now)) <= minutes * 60_000_000


def signed_in_time(commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commits whose session is trusted and was not expired when they were signed."""
    s = trusted_sessions(sessions).select("session", "expiration")
    return commits.join(s, "session").where(F.col("ts") <= F.col("expiration")).drop("expiration")


def user_by_email(users: DataFrame, email: Column) -> DataFrame:
    return users.where(F.col("email") == email).limit(1)
