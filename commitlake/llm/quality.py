"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression in numpy on the shape of a text and on how its words lean) gives each whole
text a probability.  Soft counts of all documents are then grouped by host and by path within the host.  Two Beta priors
are fitted by the method of moments, one to the spread of host means around the global mean, one to that of path means
around those of their hosts.  A host's posterior is shrunk toward the global mean, a path's toward its host without the
path's own documents, so sparse sites keep close to what is known above them and nothing counts twice.  A document's
score adds the log-odds of its path, its own count left out, to its own evidence.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents by hash of their id, whose fold isn't 0; the
site statistics cover every document.

Defined results: null and empty texts have no words and are scored on that shape; a very long text is scored whole, in
one pass over its bytes; a null host or path is a site of its own; repeated rows are rows of their own; without labels
of both kinds the document evidence is neutral (0.5); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import durable, join_small, small_batches, table

MAX_LABELLED = 6000
BUCKETS = 1 << 14
FLOOR = 1e-4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER, _SYMBOL = bytes(range(65, 91)), bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-\"")
_DIGIT = bytes(range(48, 58))


def shape_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Shape features of a whole text, and its distinct hashed words."""
    raw = text.encode() if text else b""
    words = raw.translate(_FOLD).split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    distinct = set(words)
    shape = [share(_UPPER), share(_SYMBOL), share(_DIGIT), len(distinct) / w, len(set(lines)) / max(1, len(lines)), sum(map(len, words)) / w / 10, np.log1p(len(words)) / 5, float(not words), min(1.0, len(lines) / w)]
    return np.array(shape), np.array([zlib.crc32(x) & (BUCKETS - 1) for x in distinct], dtype=np.int64)


class QualityModel:
    def __init__(self):
        self.lean = np.zeros(BUCKETS)
        self.mean, self.std, self.beta = None, None, None

    def features(self, items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = []
        for shape, words in items:
            z = self.lean[words] if len(words) else np.zeros(1)
            rows.append(np.concatenate((shape, shape[:5] ** 2, [z.mean(), z.max(), z.min()])))
        return np.array(rows).reshape(-1, 17)

    def fit(self, items: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        if len(set(y.tolist())) < 2:
            return
        count = np.zeros((2, BUCKETS))
        for (_, words), label in zip(items, y, strict=True):
            count[int(label), words] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        pool = (count.sum(0) + 0.5) / (n.sum() + 1)
        z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(pool * (1 - pool) * (1 / n).sum())
        self.lean = np.where(count.sum(0) >= 5, np.clip(z / 5, -2, 2), 0)
        x = self.features(items)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = np.hstack(((x - self.mean) / self.std, np.ones((len(x), 1))))
        beta = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.append(np.full(x.shape[1] - 1, 1.0), 1e-6)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * beta)
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def probability(self, items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(items), 0.5)
        x = np.clip((self.features(items) - self.mean) / self.std, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.hstack((x, np.ones((len(x), 1)))) @ self.beta, -9, 9)))


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    small_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(fold != 0)
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select(F.col("doc_id").alias("__i"), F.col("quality").cast("int").alias("__q")))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shape_of(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), b.column("__q")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shape", "words", "q"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__i")).select("doc_id", "text", "__q")
    got = sorted((r["doc_id"], bytes(r["shape"]), bytes(r["words"]), r["q"]) for r in rows.mapInArrow(shapes, "doc_id long, shape binary, words binary, q int").toLocalIterator())
    model = QualityModel()
    model.fit([(np.frombuffer(s), np.frombuffer(w, np.int64)) for _, s, w, _ in got], np.array([int(q > 0) for *_, q in got]))
    return model


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - FLOOR), F.greatest(F.lit(FLOOR), p))
    return F.log(q / (1 - q))


@dataclass(frozen=True)
class Priors:
    mean: float  # of all documents
    hosts: float  # how many documents the global mean counts for at a host
    paths: float  # how many documents a host counts for at one of its paths


def strength(spread: float, variance: float) -> float:
    """Weight of a Beta prior whose means spread by ``spread`` where single outcomes vary by ``variance``."""
    return float(min(1000.0, max(1.0, variance / max(spread, 1e-6) - 1)))


def fit_priors(paths: DataFrame) -> Priors | None:
    """From (host, path, n2, s2), one row per path, by the moments of both levels; None without documents.

    Expected squares around a mean are those of chance, (groups - 1) times the variance, plus the spread times what the
    sizes leave of it; solving for the spread gives the unweighted part that chance doesn't explain.
    """
    n2, s2 = F.col("n2"), F.col("s2")
    hosts = paths.groupBy("host").agg(F.sum(n2).alias("n"), F.sum(s2).alias("s"), F.count("*").alias("j"), F.sum(n2 * n2).alias("nn"), F.sum(s2 * s2 / n2).alias("ss"))
    m = F.col("s") / F.col("n")
    v = m * (1 - m)
    within = F.col("ss") - F.col("s") * m  # sum of n2 (m2 - m)^2
    got = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("h"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * m).alias("ss"), F.sum(within).alias("sq"), F.sum((F.col("j") - 1) * v).alias("chance"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("left"), F.sum(F.col("n") * v).alias("var")).first()
    if not got["n"]:
        return None
    n, mean = float(got["n"]), min(1 - FLOOR, max(FLOOR, got["s"] / got["n"]))
    v = mean * (1 - mean)
    between = (got["ss"] - n * mean**2 - (got["h"] - 1) * v) / max(n - got["nn"] / n, 1e-9)
    inner = (got["sq"] - got["chance"]) / max(got["left"], 1e-9)
    return Priors(mean, strength(between, v), strength(inner, got["var"] / n))


def site_scores(scored: DataFrame, weight: float = 0.5) -> DataFrame:
    """(doc_id, host, path, p) with host_posterior, path_posterior and score; every statistic is a grouped aggregate."""
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n2"), F.sum("p").alias("s2")), "quality-paths")
    prior = fit_priors(paths)
    if prior is None:
        return scored.select("*", *[F.lit(0.5).alias(c) for c in ("host_posterior", "path_posterior", "score")])
    hosts = paths.groupBy("host").agg(F.sum("n2").alias("n1"), F.sum("s2").alias("s1"))
    both = join_small(join_small(scored, hosts, ["host"]), paths, ["host", "path"])
    top = F.lit(prior.hosts * prior.mean)
    host = (top + F.col("s1") - F.col("p")) / (F.lit(prior.hosts) + F.col("n1") - 1)
    others = (top + F.col("s1") - F.col("s2")) / (F.lit(prior.hosts) + F.col("n1") - F.col("n2"))
    path = (F.lit(prior.paths) * others + F.col("s2") - F.col("p")) / (F.lit(prior.paths) + F.col("n2") - 1)
    out = both.withColumn("host_posterior", host).withColumn("path_posterior", path)
    z = logit(F.col("p")) + F.lit(weight) * (logit(F.col("path_posterior")) - logit(F.lit(prior.mean)))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).drop("n1", "s1", "n2", "s2")


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p, host_posterior, path_posterior, score for each row of docs."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.probability([shape_of(t) for t in b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p)], names=["doc_id", "host", "path", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    return site_scores(durable(rows.mapInArrow(run, "doc_id long, host string, path string, p double"), "quality-docs"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts and languages of a source for its paths; ``keep`` holds for a score of 0.5 or more."""
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select("doc_id", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("keep"))
