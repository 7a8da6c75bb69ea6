"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A position of the text is a word; its embedding is the sum of those of its own bucket and of the bucket of its stem
(first bytes), so that forms never seen share what is known of their stem.  Filters over one, two and three words run
along the whole text, each is max-pooled, and a dense layer gives a logit.  One embedding dimension starts from how
unevenly a bucket's document frequency falls on the two labels of the training sample, beyond what chance allows, the
others from noise; buckets with enough documents behind them are trained by gradient descent through the pooled maxima.
Scores are calibrated (Platt) on a part of the training fold that the weights never saw, weighted back to the label
ratio of the whole fold; a decision threshold for each language, shrunk toward the global one, is chosen there too.
Inputs of a score are the words of the text alone.  ``Settings`` were chosen by ``cross_validate`` on the folds 1 to 4.

Training takes at most ``MAX_POSITIVE`` + ``MAX_NEGATIVE`` labelled documents, by hash of their id, and of those, in the
order of that hash, as many as hold ``MAX_WORDS`` words; scoring takes every document and every word.

Defined results: a null, empty or wordless text is scored on padding alone; a very long text is scored whole, by parts
of ``PART`` words that overlap by the widest filter; a null doc_id can't be labelled and counts as held out; conflicting
labels of an id count as toxic; without labels of both kinds every score is 0; an unknown language uses the global
threshold; repeated rows get a row each; an empty table gives an empty result; extra columns of any name pass through
``drop_toxic`` unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = BUCKETS
MAX_POSITIVE, MAX_NEGATIVE, MAX_WORDS = 2500, 5000, 10_000_000
EPOCHS, BATCH, PART = 6, 32, 1 << 18
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUCKET: dict[int, dict[bytes, int]] = {}  # for each length of stem


@dataclass(frozen=True)
class Settings:
    """What cross-validation chose."""

    chance: float = 2.0  # deviations that a bucket's lean must exceed
    support: int = 20  # documents that a bucket needs for its embedding to be trained further
    stem: int = 6  # bytes of a word that make its stem
    noise: float = 0.02  # deviation of the embeddings of trained buckets that have no lean


def word_ids(text: str | None, stem: int = Settings.stem) -> np.ndarray:
    """(words, 2): the bucket of each word and that of its stem."""
    words = text.encode().translate(_FOLD).split() if text else []
    if not words:
        return np.zeros((0, 2), dtype=np.int32)
    keyed = _BUCKET.setdefault(stem, {})
    new = set(words).difference(keyed)
    if len(keyed) + len(new) > 1_000_000:
        keyed.clear()
        new = set(words)
    keyed.update((w, (zlib.crc32(w) & (BUCKETS - 1)) << 32 | zlib.crc32(w[:stem], 1) & (BUCKETS - 1)) for w in new)
    both = np.fromiter(map(keyed.__getitem__, words), np.int64, len(words))
    return np.stack((both >> 32, both & (BUCKETS - 1)), axis=1).astype(np.int32)


def _lay_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in a row, three paddings after each; the first and past-the-last window of each."""
    pad = np.full((3, 2), PAD, dtype=np.int32)
    lengths = np.array([len(d) for d in docs])
    ends = np.cumsum(lengths + 3)
    flat = np.concatenate([x for d in docs for x in (d, pad)] + [pad])
    return flat, ends - lengths - 3, ends - 2  # a window may start at a document's first padding


class Model:
    def __init__(self, settings: Settings | None = None, seed: int = 5):
        self.settings = settings or Settings()
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.emb[PAD] = 0
        self.conv = [rng.normal(0, 0.3 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0, :2] = np.array((1.0, -1.0)) / len(c)  # two filters of each width start on the informed dimension
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.b, self.scale = 0.0, (1.0, 0.0)
        self.thresholds: dict[str | None, float] = {None: 0.5}
        self.trained = False

    def inform(self, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Set the embeddings to start from; returns which buckets are trained.

        Near copies of a document (equal bottom-8 sketches of its buckets) count once, lest the words of one much
        copied text look like words of a label.  Buckets of too few documents to be trained are silent unless they
        lean: a long text has many of them, and a maximum over noise grows with length.
        """
        seen: dict[bytes, set[int]] = {}
        count = np.zeros((2, BUCKETS))
        n = [0, 0]
        for d, label in zip(docs, y, strict=True):
            own = np.unique(d)
            sketch = np.sort(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:8].tobytes()
            if int(label) in seen.setdefault(sketch, set()):
                continue
            seen[sketch].add(int(label))
            count[int(label), own] += 1
            n[int(label)] += 1
        pool = (count.sum(0) + 0.5) / (sum(n) + 1)
        z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(pool * (1 - pool) * (1 / n[1] + 1 / n[0]))
        lean = np.where(count.sum(0) >= 3, np.sign(z) * np.maximum(np.abs(z) - self.settings.chance, 0) / 5, 0)
        often = count.sum(0) >= self.settings.support
        self.emb[:BUCKETS] *= np.where(lean != 0, 0.1, np.where(often, self.settings.noise, 0))[:, None]
        self.emb[:BUCKETS, 0] = np.clip(lean, -3, 3)
        return np.append(often & ((lean != 0) | (self.settings.noise > 0)), False)

    def _pool(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima (docs, widths * filters) and where their windows start."""
        x, best, where = self.emb[flat].sum(1), [], []
        for w, c, bias in zip(WIDTHS, self.conv, self.bias, strict=True):
            n = len(flat) - w + 1
            out = sum(x[j : j + n] @ c[j] for j in range(w)) + bias
            at = np.stack([a + out[a:b].argmax(0) for a, b in zip(first, last, strict=True)])
            best.append(np.take_along_axis(out, at, 0))
            where.append(at)
        return np.hstack(best), np.hstack(where)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 11) -> None:
        trainable = self.inform(docs, y)
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        params = [self.dense, *self.conv, *self.bias]
        m, v, step, b_m, b_v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0, 0.0
        power = np.full(self.emb.shape, 0.1, np.float32)
        epochs = max(EPOCHS, min(40, 20_000 // len(docs)))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                flat, first, last = _lay_out([docs[i] for i in pick])
                pooled, at = self._pool(flat, first, last)
                act = np.maximum(pooled, 0)
                err = (1 / (1 + np.exp(-np.clip(act @ self.dense + self.b, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                grads = [act.T @ err + 1e-3 * self.dense]
                g_pool = np.outer(err, self.dense) * (pooled > 0)
                g_conv, g_bias = [], []
                for k, w in enumerate(WIDTHS):
                    g, a, c = g_pool[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS], self.conv[k]
                    g_c = np.zeros_like(c)
                    for j in range(w):
                        ids = flat[a + j]
                        g_c[j] = np.einsum("bf,bfd->df", g, self.emb[ids].sum(2))
                        g_e = (g[:, :, None] * c[j].T[None]).reshape(-1, DIM)
                        for part in (0, 1):  # the word's bucket and its stem's get the same gradient
                            rows = ids[:, :, part].ravel()
                            live = trainable[rows] & (np.abs(g.ravel()) > 0)
                            rows, g_live = rows[live], g_e[live]
                            np.add.at(power, rows, g_live**2)
                            np.subtract.at(self.emb, rows, (0.02 * g_live / np.sqrt(power[rows])).astype(np.float32))
                    g_conv.append(g_c + 1e-4 * c)
                    g_bias.append(g.sum(0))
                step += 1
                for p, g, m1, v1 in zip(params, grads + g_conv + g_bias, m, v, strict=True):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    p -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
                g_b = float(err.sum())
                b_m += 0.1 * (g_b - b_m)
                b_v += 0.001 * (g_b * g_b - b_v)
                self.b -= 0.01 * (b_m / (1 - 0.9**step)) / (np.sqrt(b_v / (1 - 0.999**step)) + 1e-8)
        self.trained = True

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        flat, first, last = _lay_out(docs)
        cuts = np.stack([first, last], axis=1).ravel()
        x = self.emb[flat[:, 0]] + self.emb[flat[:, 1]]
        every = x @ np.concatenate([c[j] for c in self.conv for j in range(len(c))], axis=1)
        out, at = [], 0
        for w, bias in zip(WIDTHS, self.bias, strict=True):
            n = len(flat) - w + 1
            sums = every[:n, at : at + FILTERS].copy()
            for j in range(1, w):
                sums += every[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            out.append(np.maximum.reduceat(sums, cuts, axis=0)[::2] + bias)
        return np.hstack(out)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Texts go together up to about ``PART`` words; a longer one by parts, whose maxima are combined."""
        best, held, size = [np.zeros((0, len(WIDTHS) * FILTERS))], [], 0
        for d in docs:
            if held and size + len(d) > PART:
                best.append(self.pooled(held))
                held, size = [], 0
            if len(d) > PART:
                step = PART - max(WIDTHS) + 1
                parts = [self._inner(d[at : at + PART], at + PART < len(d)) for at in range(0, len(d), step)]
                best.append(np.max(parts, axis=0)[None])
                continue
            held.append(d)
            size += len(d)
        if held:
            best.append(self.pooled(held))
        return np.maximum(np.concatenate(best), 0).astype(float) @ self.dense + self.b

    def _inner(self, part: np.ndarray, more: bool) -> np.ndarray:
        """Maxima of a part of a text; where the text goes on, windows that reach past the part are left to the next."""
        if not more:
            return self.pooled([part])[0]
        x, out = self.emb[part].sum(1), []
        for w, c, bias in zip(WIDTHS, self.conv, self.bias, strict=True):
            n = len(part) - w + 1
            out.append(sum(x[j : j + n] @ c[j] for j in range(w)).max(0) + bias)
        return np.concatenate(out)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list[str | None]) -> None:
        """Platt scaling on weighted rows, then thresholds by language that maximise F1 there."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            g = np.array([(weight * (p - y) * logits).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum()])
            h = weight * p * (1 - p)
            hess = np.array([[(h * logits**2).sum() + 1e-2, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]])
            da, db = np.linalg.solve(hess, g)
            step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
            a, b = max(1e-3, a - step * da), b - step * db
        self.scale = (a, b)
        p = self.probability(logits)

        def best(rows: np.ndarray) -> float:
            cuts = np.unique(np.round(p[rows], 3))
            cuts = cuts[(cuts > 0.2) & (cuts < 0.8)]
            f1 = lambda t: 2 * (weight[rows] * y[rows] * (p[rows] >= t)).sum() / max(1e-9, (weight[rows] * (y[rows] + (p[rows] >= t))).sum())
            ranked = sorted([0.5, *cuts], key=lambda t: (-round(f1(t), 4), abs(t - 0.5)))
            return float(ranked[0])

        every = best(np.arange(len(y)))
        self.thresholds = {None: every}
        for lang in sorted({x for x in langs if x is not None}):
            rows = np.array([i for i, x in enumerate(langs) if x == lang])
            known = float(y[rows].sum())
            self.thresholds[lang] = (known * best(rows) + 25 * every) / (known + 25)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(logits))
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def labelled(docs: DataFrame, labels: DataFrame, stem: int = Settings.stem) -> tuple[list[tuple], dict[int, int]]:
    """(doc_id, word ids, lang, toxic, fold) of the sample whose fold isn't 0, and how many documents have each label."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0).cache()
    total = {int(r["toxic"] > 0): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = [known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for cond, n in (("toxic > 0", MAX_POSITIVE), ("toxic <= 0", MAX_NEGATIVE))]
    chosen = F.broadcast(pick[0].unionByName(pick[1]).select(F.col("doc_id").alias("__i"), "toxic", fold().alias("__f"), F.xxhash64("doc_id").alias("__h")))  # bounded by the two limits
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("__l")).join(chosen, F.col("doc_id") == F.col("__i"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_ids(t, stem) for t in b.column("text").to_pylist()]
            cols = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, b.column("__l"), b.column("toxic"), b.column("__f"), b.column("__h")], names=["doc_id", "ids", "n", "lang", "toxic", "f", "h"])

    sample = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__l", F.col("toxic").cast("int").alias("toxic"), F.col("__f").cast("int").alias("__f"), "__h")
    coded = sample.mapInArrow(encode, "doc_id long, ids binary, n long, lang string, toxic int, f int, h long").cache()
    # the words are counted before any of them is fetched: an id's texts may be many and long
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in coded.select("h", "doc_id", "n").toLocalIterator())
    words = np.cumsum([n for *_, n in sizes])
    past = [h for (h, *_), w in zip(sizes, words, strict=True) if w > MAX_WORDS]
    fits = coded if not past else coded.where(F.col("h") < past[0])
    got = [(r["doc_id"], np.frombuffer(bytes(r["ids"]), dtype=np.int32).reshape(-1, 2), r["lang"], int(r["toxic"] > 0), r["f"]) for r in fits.toLocalIterator()]
    coded.unpersist()
    known.unpersist()
    return sorted(got, key=lambda r: (r[0], len(r[1]), r[1].tobytes())), total


def fitted(got: list[tuple], total: dict[int, int], settings: Settings | None = None, held_fold: int = 1) -> Model:
    """Weights from all folds but one, which calibrates."""
    model = Model(settings)
    fit, held = [r for r in got if r[4] != held_fold], [r for r in got if r[4] == held_fold]
    y = np.array([r[3] for r in fit])
    if len(set(y.tolist())) < 2:
        return model
    model.fit([r[1] for r in fit], y)
    if len({r[3] for r in held}) < 2:
        held = fit
    seen = {k: sum(r[3] == k for r in got) for k in (0, 1)}
    weight = np.array([total.get(r[3], 1) / seen[r[3]] for r in held])
    model.calibrate(model.logits([r[1] for r in held]), np.array([r[3] for r in held]), weight / weight.mean(), [r[2] for r in held])
    return model


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on the documents whose fold isn't 0; the fold 1 only calibrates."""
    return fitted(*labelled(docs, labels, (settings or Settings()).stem), settings)


def cross_validate(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[int, float]]:
    """(label, score) of each document of the folds 1 to 4, from a model that never saw its fold."""
    got, total = labelled(docs, labels, settings.stem)
    out: list[tuple[int, float]] = []
    for f in (1, 2, 3, 4):
        model = fitted([r for r in got if r[4] != f], total, settings, held_fold=f % 4 + 1)
        rows = [r for r in got if r[4] == f]
        out += zip([r[3] for r in rows], model.probability(model.logits([r[1] for r in rows])).tolist(), strict=True)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score) for each row of docs (doc_id, text, lang where there is one)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by BUCKETS, DIM and FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.probability(m.logits([word_ids(t, m.settings.stem) for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(p)], names=["doc_id", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(run, "doc_id long, lang string, score double")


def flagged(model: Model):
    """The decision: score at or over the threshold of the language."""
    cut = F.lit(model.thresholds[None])
    for lang, t in model.thresholds.items():
        if lang is not None:
            cut = F.when(F.col("lang") == lang, F.lit(t)).otherwise(cut)
    return F.col("score") >= cut


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't flag; the text is read, scored and passed on in one scan."""
    spark = docs.sparkSession
    model = train(docs, labels)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    has_lang, names = "lang" in docs.columns, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.probability(m.logits([word_ids(t, m.settings.stem) for t in b.column(b.schema.get_field_index("text")).to_pylist()]))
            langs = b.column(b.schema.get_field_index("lang")).to_pylist() if has_lang else [None] * b.num_rows
            cut = np.array([m.thresholds.get(x, m.thresholds[None]) for x in langs])
            yield b.filter(pa.array(p < cut))

    return docs.mapInArrow(run, docs.schema).select(names)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), flagged(model).alias("flagged"))
