"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed in a few tables, each by Gaussian projections (made orthogonal within a table) that are cut
into cells of one width.  A query's own cell is perturbed: from the chance that a neighbour at the fitted cosine falls
into each cell of each projection, the ``probes`` likeliest buckets are generated in order of success, without looking
at what buckets exist.  Every member of a visited bucket is compared by its cosine; merging the tables' candidates and
scoring them exactly gives the nearest of all that were met.

Number of hashes, tables and probes are chosen on a sample of at most ``SAMPLE`` vectors (by hash; neighbours are farther
there than among all, which errs toward more probes): of the plans whose recall there is ``WANTED``, for all its queries
and for those with far neighbours alone, the one that compares least.  Every vector is indexed.  Where no plan reaches
it, every bucket is visited, which is exact.

Buckets that share the cells of their first projections are one group of work.  Large groups are cut into chunks of
about ``CHUNK`` members and ``QUERY_CHUNK`` queries.  Of rows with equal vectors only the first k + 1 can be in an
answer, so no more are indexed, and equal queries are searched once: copies don't crowd a bucket.

Defined results: vectors that are null or zero or hold null or non-finite components take no part; vectors of
different lengths are never candidates of each other; a repeated vec_id is a row of its own, as query and as
candidate; ties go to the smaller id; a null vec_id takes no part; a query that met too few candidates is repeated over
all buckets; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, erf, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from .common import durable, join_small, small_batches, table

K = 5
WIDTH, REACH = 2.5, 3.2  # of a cell, and where the outermost ones begin, in deviations of a projection
BASE = int(2 * REACH / WIDTH) + 2  # cells of a projection at most
SAMPLE, SAMPLE_QUERIES = 4096, 200
HASHES, TABLES, PROBES = (4, 6, 8, 12, 16), (1, 2, 4), (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
PROBE_COST = 0.25  # members that could be compared for the price of a probe
CHUNK, QUERY_CHUNK = 2048, 8192
WANTED = 0.94
_GRID = np.linspace(-8, 8, 16_001)
_PHI = np.array([0.5 * (1 + erf(x / 2**0.5)) for x in _GRID])


def _phi(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _PHI)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as float64."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=64)
def _projection(dim: int, hashes: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((3, dim, hashes, t))
    a = rng.normal(size=(dim, hashes))
    if dim >= hashes:
        a = np.linalg.qr(a)[0] * dim**0.5
    return a, rng.uniform(0, WIDTH, hashes)


@dataclass(frozen=True)
class Plan:
    hashes: int
    tables: int
    probes: int  # 0: every bucket
    cosine: float  # of the neighbours that are to be found

    def project(self, t: int, x: np.ndarray) -> np.ndarray:
        return x @ _projection(x.shape[1], self.hashes, t)[0]

    def _edges(self, dim: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest cell of each projection."""
        shift = _projection(dim, self.hashes, t)[1]
        return np.floor((shift - REACH) / WIDTH).astype(np.int64), np.floor((shift + REACH) / WIDTH).astype(np.int64)

    def buckets(self, t: int, x: np.ndarray) -> np.ndarray:
        low, high = self._edges(x.shape[1], t)
        cell = np.floor((self.project(t, x) + _projection(x.shape[1], self.hashes, t)[1]) / WIDTH).astype(np.int64)
        return (np.clip(cell, low, high) - low) @ BASE ** np.arange(self.hashes - 1, -1, -1, dtype=np.int64)

    def sequence(self, t: int, x: np.ndarray, n: int) -> np.ndarray:
        """(queries, n or fewer) buckets, likeliest first.

        A neighbour's projection is normal around the cosine times the query's.  Of the buckets that agree with one of
        the likeliest n so far in the projections done, only n can be among the likeliest n in the end.
        """
        p, shift = self.project(t, x), _projection(x.shape[1], self.hashes, t)[1]
        low, high = self._edges(x.shape[1], t)
        mean, dev = self.cosine * p, max(1e-3, 1 - self.cosine**2) ** 0.5
        score, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for h in range(self.hashes):
            edge = np.arange(low[h], high[h] + 2) * WIDTH - shift[h]
            edge[0], edge[-1] = -1e9, 1e9
            cut = _phi((edge[None] - mean[:, h : h + 1]) / dev)
            chance = np.log(np.maximum(np.diff(cut, axis=1), 1e-30))
            score = (score[:, :, None] + chance[:, None]).reshape(len(x), -1)
            code = (code[:, :, None] * BASE + np.arange(high[h] - low[h] + 1)).reshape(len(x), -1)
            if score.shape[1] > n:
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                score, code = np.take_along_axis(score, top, 1), np.take_along_axis(code, top, 1)
        return np.take_along_axis(code, np.argsort(-score, axis=1, kind="stable"), 1)


def fit(sample: np.ndarray, total: int, k: int = K) -> tuple[Plan, float]:
    """The plan that compares least of those with the wanted recall, and the share of a table it compares a query with."""
    x = unit(sample)
    n = len(x)
    if n < 2:
        return Plan(HASHES[0], 1, 0, 0.0), 1.0
    q = np.arange(min(SAMPLE_QUERIES, n))
    cos = x[q] @ x.T
    cos[q, q] = -9
    best = np.argsort(-cos, axis=1)[:, : min(k, n - 1)]
    last = np.take_along_axis(cos, best, 1)[:, -1]
    away = np.sqrt(np.maximum(0, 2 - 2 * last))
    far = away >= away.max() / 2
    cosine = float(np.clip(np.median(last[far]), 0.05, 0.999))
    found, least = Plan(HASHES[0], 1, 0, cosine), (float(total), 1.0)
    for hashes in HASHES:
        ranks = []  # when each member's bucket is visited
        for t in range(max(TABLES)):
            plan = Plan(hashes, 1, 0, cosine)
            members, order = plan.buckets(t, x), plan.sequence(t, x[q], max(PROBES))
            rank = np.full((len(q), n), max(PROBES), dtype=np.int32)
            for i, codes in enumerate(order):
                by = np.argsort(codes)
                at = by[np.minimum(np.searchsorted(codes[by], members), len(codes) - 1)]
                rank[i] = np.where(codes[at] == members, at, max(PROBES))
            ranks.append(rank)
        for tables in TABLES:
            near = np.min([np.take_along_axis(r, best, 1) for r in ranks[:tables]], axis=0)
            for probes in PROBES:
                recall = min((near < probes).mean(), (near[far] < probes).mean())
                if recall >= WANTED:
                    share = float(sum((r < probes).mean() for r in ranks[:tables]))
                    cost = share * total + PROBE_COST * tables * probes
                    if cost < least[0]:
                        found, least = Plan(hashes, tables, probes, cosine), (cost, share)
                    break
    return found, least[1]


def nearest(queries: np.ndarray, visits: list[tuple[np.ndarray, slice]], members: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of the k best of each query, ties to the smaller (id, row); ``visits`` says who meets whom."""
    qn, mn = np.sqrt((queries * queries).sum(1)), np.sqrt((members * members).sum(1))
    qi, mi, rough = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for asked, part in visits:
        block = members[part] / mn[part, None]
        for at in range(0, len(asked), 1024):
            some = asked[at : at + 1024]
            cos = queries[some] @ block.T / qn[some, None]
            kk = min(k, cos.shape[1])
            r, c = np.nonzero(cos >= np.partition(cos, cos.shape[1] - kk, axis=1)[:, cos.shape[1] - kk, None] - 1e-9)
            qi.append(some[r])
            mi.append(c + part.start)
            rough.append(cos[r, c])
    qi, mi, rough = np.concatenate(qi), np.concatenate(mi), np.concatenate(rough)
    by = np.lexsort((-rough, qi))
    qi, mi, rough = qi[by], mi[by], rough[by]
    first = np.searchsorted(qi, qi, side="left")
    kth = rough[np.minimum(first + k - 1, np.searchsorted(qi, qi, side="right") - 1)]
    qi, mi = qi[rough >= kth - 1e-9], mi[rough >= kth - 1e-9]
    # summed row by row, so that equal vectors score equally wherever they stand in a block
    exact = np.concatenate([np.zeros(0)] + [(members[mi[a : a + 65_536]] * queries[qi[a : a + 65_536]]).sum(1) for a in range(0, len(qi), 65_536)]) / (qn[qi] * mn[mi])
    by = np.lexsort((rows[mi], ids[mi], -exact, qi))
    qi, mi, exact = qi[by], mi[by], exact[by]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], mi[keep], exact[keep]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v, dim, c1, c2): rows that take part, with two hashes that name their vector."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    kept = some.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    return kept.select("*", F.size("v").alias("dim"), F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(1), "v").alias("c2"))


def _by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), b if (sizes == d).all() else b.filter(pa.array(sizes == d))


def _index(members: DataFrame, plan: Plan, prefix: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b, "v"):
                x = unit(_matrix(part.column("v")))
                for t in range(plan.tables):
                    bucket = plan.buckets(t, x)
                    group = bucket // BASE ** (plan.hashes - prefix)
                    cols = [pa.array(np.full(len(x), dim, np.int32)), pa.array(np.full(len(x), t, np.int32)), pa.array(group), pa.array(bucket)]
                    yield pa.RecordBatch.from_arrays([*cols, part.column("row"), part.column("vec_id"), part.column("v")], names=["dim", "tab", "grp", "bucket", "row", "vec_id", "v"])

    return members.select("row", "vec_id", "v").mapInArrow(run, f"dim int, tab int, grp long, bucket long, row long, vec_id long, v {kind}")


def _visits(asked: DataFrame, plan: Plan, prefix: int, kind: str) -> DataFrame:
    """(dim, tab, grp, query, buckets, q): a row for each group that a query enters, with the buckets it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, b in _by_length(whole, "q"):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    x = unit(_matrix(part.column("q")))
                    for t in range(plan.tables):
                        order = plan.sequence(t, x, plan.probes)
                        query, bucket = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
                        group = bucket // BASE ** (plan.hashes - prefix)
                        by = np.lexsort((group, query))
                        query, bucket, group = query[by], bucket[by], group[by]
                        first = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (group[1:] != group[:-1]))))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)).astype(np.int32)), pa.array(bucket))
                        took = part.take(pa.array(query[first]))
                        cols = [pa.array(np.full(len(first), dim, np.int32)), pa.array(np.full(len(first), t, np.int32)), pa.array(group[first])]
                        yield pa.RecordBatch.from_arrays([*cols, took.column("query"), lists, took.column("q")], names=["dim", "tab", "grp", "query", "buckets", "q"])

    return asked.select("query", "q").mapInArrow(run, f"dim int, tab int, grp long, query long, buckets array<long>, q {kind}")


def _compare(visits: DataFrame, index: DataFrame, k: int, every: bool) -> DataFrame:
    """(query, row, vec_id, score): the k best of each query in each group; ``every`` ignores the list of buckets."""

    def scan(key: tuple, asked: pa.Table, members: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids, rows, query = (c.to_numpy().astype(np.int64) for c in (members.column("vec_id"), members.column("row"), asked.column("query")))
        if len(query) and len(ids):
            bucket = members.column("bucket").to_numpy()
            by = np.argsort(bucket, kind="stable")
            bucket, ids, rows, x, q = bucket[by], ids[by], rows[by], _matrix(members.column("v"))[by], _matrix(asked.column("q"))
            known, first = np.unique(bucket, return_index=True)
            last = np.append(first[1:], len(bucket))
            if every:
                visits = [(np.arange(len(q)), slice(0, len(x)))]
            else:
                lists = asked.column("buckets").combine_chunks()
                who, what = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, what), len(known) - 1)
                hit = known[at] == what
                order = np.argsort(at[hit], kind="stable")
                who, at = who[hit][order], at[hit][order]
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                visits = [(w, slice(int(first[at[c]]), int(last[at[c]]))) for c, w in zip(cut, np.split(who, cut[1:]), strict=True)] if len(at) else []
            got = nearest(q, visits, x, ids, rows, k)
        return pa.table({"query": query[got[0]], "row": rows[got[1]], "vec_id": ids[got[1]], "score": got[2]})

    keys = ["dim", "tab", "grp"]
    sizes = index.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("__chunks"))
    asked = visits.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("__parts"))
    layout = sizes.join(asked, keys)  # a row for each group
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = [*keys, "__chunk", "__part"]
    left = join_small(visits, layout, keys).withColumn("__part", deal("query", "__parts")).withColumn("__chunk", spread("__chunks")).select(*both, "query", "buckets", "q")
    other = layout.toDF(*keys, "__c", "__p")
    right = join_small(index, other, keys).withColumn("__chunk", deal("row", "__c")).withColumn("__part", spread("__p")).select(*both, "bucket", "row", "vec_id", "v")
    found = left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(scan, "query long, row long, vec_id long, score double")
    return found.groupBy("query", "row", "vec_id").agg(F.max("score").alias("score"))


def neighbours(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) for which ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    base = durable(valid_vectors(vectors), "ann-vectors")
    kind = base.schema["v"].dataType.simpleString()
    first = F.row_number().over(W.partitionBy("c1", "c2").orderBy("vec_id", "row"))
    members = durable(base.withColumn("__n", first).where(F.col("__n") <= k + 1).drop("__n"), "ann-members")  # limited before the shuffle, too
    sample = members.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(r["v"]) for r in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    plenty = {r["dim"]: r["n"] for r in members.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a number for each length
    total = sum(plenty.values())
    plan, _ = fit(np.array([r["v"] for r in sample if len(r["v"]) == dim], dtype=np.float64), plenty[dim], k)
    prefix = min(plan.hashes, max(1, ceil(log(max(1, total / CHUNK)) / log(2.5))))  # a projection parts its members about 2.5 ways
    queries = base.where(is_query).select("row", "vec_id", "c1", "c2", "v")
    distinct = durable(queries.groupBy("c1", "c2").agg(F.min("row").alias("query"), F.first("v").alias("q")), "ann-queries")
    index = _index(members, plan, prefix, kind)
    every = index.where("tab = 0").groupBy("dim", "grp").agg(F.lit(0).alias("tab"))
    everywhere = lambda some: join_small(some.withColumn("dim", F.size("q")), every, ["dim"]).select("dim", "tab", "grp", "query", F.lit(None).cast("array<long>").alias("buckets"), "q")
    visits = durable(_visits(distinct, plan, prefix, kind) if plan.probes else everywhere(distinct), "ann-visits")
    found = durable(_compare(visits, index, k + 1, not plan.probes), "ann-found")
    met = found.groupBy("query").agg(F.count("*").alias("n"))
    enough = F.lit(0)
    for d, n in plenty.items():
        enough = F.when(F.size("q") == d, F.lit(min(k + 1, n))).otherwise(enough)
    lacking = durable(distinct.join(met, "query", "left").where(F.coalesce("n", F.lit(0)) < enough).select("query", "q"), "ann-lacking")
    if not lacking.isEmpty():
        rest = _compare(durable(everywhere(lacking), "ann-visits"), index.where("tab = 0"), k + 1, True)
        found = found.join(lacking, "query", "left_anti").unionByName(durable(rest, "ann-rest"))
    order = [F.desc("score"), "vec_id", "row"]
    top = found.withColumn("__n", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("__n") <= k + 1)
    lists = top.groupBy("query").agg(F.collect_list(F.struct("vec_id", "row", "score")).alias("near"))  # k + 1 each
    answers = distinct.select("c1", "c2", "query").join(lists, "query").select("c1", "c2", "near")
    out = join_small(queries.select(F.col("row").alias("__own"), F.col("vec_id").alias("query_id"), "c1", "c2"), answers, ["c1", "c2"])
    ranked = F.array_sort(F.filter("near", lambda x: x["row"] != F.col("__own")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).when(a["row"] < b["row"], -1).otherwise(1))
    return out.select("query_id", F.posexplode(F.slice(ranked, 1, k))).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
