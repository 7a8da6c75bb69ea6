"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: The commit log of ``synthetic_commits``, and what the version graph derives from it, for any SQL engine.
LOG = """
with w as (select *, row_number() over u as rn, lag(event_id, 1) over u as p1, lag(event_id, 2) over u as p2
  from events window u as (partition by user_id order by event_id)),
commits as (select event_id as id, user_id as key, event_type as connection, user_id % 7 as session, ts, event_id + 1 as age, rn,
  case when rn = 1 then []::bigint[] when rn % 11 = 0 then [p1, p2] when rn % 5 = 0 then [p2] else [p1] end as parents,
  value, json_extract_string(props, '$.k')::bigint as k, event_type, rn % 17 = 0 as is_deleted, (1 + event_id % 2)::int as scheme_version,
  case when rn % 3 <> 0 then last_value(case when rn % 3 = 0 then event_id end ignore nulls)
    over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) end as base from w),
edges as (select id, unnest(parents) as parent, key from commits),
leaves_raw as (select * from commits c where not exists (select 1 from edges e where e.parent = c.id)),
leaves as (select * from leaves_raw qualify row_number() over (partition by key, connection order by ts desc, id desc) = 1),
heads as (select * from leaves qualify row_number() over (partition by key order by ts desc, id desc) = 1),
items as (select * from heads where not is_deleted)
"""
