"""A Spark result against the rows that DuckDB gives for the SQL of the same query."""

import math
from datetime import datetime
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 4; set TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def assert_same(df, sql, sf_dir):
    names, mine = spark_rows(df)
    other, theirs = duck_rows(sql, sf_dir)
    assert names == other
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == b
