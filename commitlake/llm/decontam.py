"""Benchmark decontamination with a distributed positional inverted index.

One pass over the corpus writes the index: a row for each document (its word count) and postings (term, document,
position) of the terms that benchmark windows use.  A posting is left out only where it can't be part of a match: in
a phrase every word is a benchmark term, so a run of such terms that is shorter than the shortest window of a term
holds no match with it (``slack`` widens runs for proximity search).  List lengths over the whole index rank the
terms of each window.  Matching starts from the postings of the rarest term, shifts them to window starts, and
intersects with the offset-adjusted lists of the second and third rarest; the other terms are then met in one join.

The benchmark is broadcast: its number of windows is checked against ``MAX_WINDOWS``, beyond which it is refused.

Defined results: a null or blank text has no words, no hits and the digest of the empty string; a very long text is
scanned whole in one task and its postings are rows like any others; items with a null id or without words match
nothing; repeated ids of documents are separate rows, and equal item ids are one item; empty documents give an empty
result and an empty benchmark no hits; extra columns are not read, and pass through ``drop_contaminated`` but for
``__uid``, which is refused.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from .common import durable, reserve, small_batches, table

WINDOW = 8
MAX_WINDOWS = 500_000  # of them the driver holds 0.2 GB as words and 80 MB as numbers
#: Bytes to lower-cased words parted by spaces: ASCII letters and digits and all bytes from 0x80 on are word bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def benchmark_windows(benchmark: DataFrame) -> list[tuple[str, tuple[bytes, ...]]]:
    """Distinct (item id as string, words) of all windows; a bounded table."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    found: dict[tuple[str, tuple[bytes, ...]], None] = {}
    for r in rows.toLocalIterator():
        w = words_of(r["text"])
        for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
            found[(r["i"], tuple(w[k : k + WINDOW]))] = None
        if len(found) > MAX_WINDOWS:
            raise ValueError(f"the benchmark has over {MAX_WINDOWS} windows; split it into several runs")
    return list(found)


def _runs(at: np.ndarray, gap: int) -> np.ndarray:
    """Length of the run that each position is in; neighbours of a run are at most ``gap`` apart."""
    cut = np.flatnonzero(np.diff(at) > gap) + 1
    lengths = np.diff(np.concatenate(([0], cut, [len(at)])))
    return np.repeat(lengths, lengths)


def build_index(docs: DataFrame, windows: list[tuple[str, tuple[bytes, ...]]], slack: int = 0, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, n_words, term, pos): a document's row has a null term, a posting's row a null n_words.

    ``uid`` names a column of unique row ids to take; without it rows are numbered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = {t: i for i, t in enumerate(sorted({t for _, w in windows for t in w}))}
    shortest = np.full(len(terms), WINDOW, dtype=np.int64)
    for _, w in windows:
        for t in w:
            shortest[terms[t]] = min(shortest[terms[t]], len(w))
    shared = spark.sparkContext.broadcast((terms, shortest))  # bounded by MAX_WINDOWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, least = shared.value
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            rows, counts, owner, term, pos = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows.append(doc)
                counts.append(len(words))
                code = np.fromiter(map(ids.get, words, (-1 for _ in words)), dtype=np.int64, count=len(words))
                at = np.flatnonzero(code >= 0)
                if len(at):
                    at = at[_runs(at, 1 + slack) >= least[code[at]]]
                    owner.append(np.full(len(at), len(rows) - 1))
                    term.append(code[at])
                    pos.append(at)
            n = len(rows)
            which = np.concatenate([np.arange(n), *owner]).astype(np.int64)
            extra = len(which) - n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(which + base) if uid is None else b.column(2).take(pa.array(which)),
                    pa.array(rows, pa.int64()).take(pa.array(which)),
                    pa.array(counts + [None] * extra, pa.int64()),
                    pa.array([None] * n, pa.int32()) if not extra else pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(term).astype(np.int32))]),
                    pa.array([None] * n, pa.int32()) if not extra else pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate(pos).astype(np.int32))]),
                ],
                names=["uid", "doc_id", "n_words", "term", "pos"],
            )
            base += n

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if uid is None else [uid])).mapInArrow(scan, "uid long, doc_id long, n_words long, term int, pos int")
    return durable(index, "postings")


def ranked_windows(spark: SparkSession, index: DataFrame, windows: list[tuple[str, tuple[bytes, ...]]]) -> DataFrame:
    """(win, size, rank, term, offset): terms of each distinct window, the one with the shortest list first."""
    number = {t: i for i, t in enumerate(sorted({t for _, w in windows for t in w}))}
    lists = index.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    length = {r["term"]: r["n"] for r in lists.toLocalIterator()}  # a number for each benchmark term
    rows = array("i")
    for k, w in enumerate(dict.fromkeys(w for _, w in windows)):
        parts = sorted((length.get(number[t], 0), number[t], o) for o, t in enumerate(w))
        if parts[0][0]:  # a term that no document has: the window occurs nowhere
            for r, (_, t, o) in enumerate(parts):
                rows.extend((k, len(w), r, t, o))
    cols = np.frombuffer(rows, np.int32).reshape(-1, 5) if rows else np.zeros((0, 5), np.int32)
    names = ["win", "size", "rank", "term", "off"]
    return spark.createDataFrame(pa.table({n: np.ascontiguousarray(cols[:, i]) for i, n in enumerate(names)}))


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(uid, win, start, size): all exact occurrences of windows."""
    posts = index.where("term is not null").select("uid", "term", "pos")
    first = F.broadcast(terms.where("rank = 0"))
    found = posts.join(first, "term").select("uid", "win", (F.col("pos") - F.col("off")).alias("start"), "size").where("start >= 0")
    for rank in (1, 2):
        step = F.broadcast(terms.where(f"rank = {rank}").select("win", F.col("term").alias("__t"), F.col("off").alias("__o")))
        wide = found.join(step, "win", "left").withColumn("__p", F.col("start") + F.col("__o"))
        other = posts.select(F.col("uid").alias("__u"), F.col("term").alias("__t2"), F.col("pos").alias("__p2"))
        hit = wide.where("__t is not null").join(other, (F.col("uid") == F.col("__u")) & (F.col("__t") == F.col("__t2")) & (F.col("__p") == F.col("__p2")), "left_semi")
        short = found.where(f"size <= {rank}")
        found = short.unionByName(hit.select(found.columns))
    rest = F.broadcast(terms.where("rank >= 3").select("win", F.col("term").alias("__t"), F.col("off").alias("__o")))
    wide = found.where("size > 3").join(rest, "win").withColumn("__p", F.col("start") + F.col("__o"))
    other = posts.select(F.col("uid").alias("__u"), F.col("term").alias("__t2"), F.col("pos").alias("__p2"))
    hit = wide.join(other, (F.col("uid") == F.col("__u")) & (F.col("__t") == F.col("__t2")) & (F.col("__p") == F.col("__p2")), "left_semi")
    full = hit.groupBy("uid", "win", "start", "size").agg(F.count("*").alias("__n")).where("__n = size - 3").drop("__n")
    return found.where("size <= 3").unionByName(full)


def proximity_matches(index: DataFrame, terms: DataFrame, reach: int = 12) -> DataFrame:
    """(uid, win, pos): occurrences of a window's rarest term with every other term within ``reach`` words of it.

    Positions are cut into bins of ``reach`` words and looked up in three, so it is an equi-join.  Build the index
    with ``slack`` of at least ``2 * reach`` or on windows of single words for complete results.
    """
    posts = index.where("term is not null").select("uid", "term", "pos")
    anchor = posts.join(F.broadcast(terms.where("rank = 0").select("win", "term")), "term").select("uid", "win", "pos")
    others = terms.select("win", "term").distinct().join(terms.where("rank = 0").select("win", F.col("term").alias("__a")), "win").where("term <> __a").select("win", F.col("term").alias("__t"))
    need = others.groupBy("win").agg(F.count("*").alias("__need"))
    bins = F.explode(F.array(*[F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)])).alias("__b")
    wide = anchor.join(F.broadcast(others), "win").select("uid", "win", "pos", "__t", bins)
    near = posts.select(F.col("uid").alias("__u"), F.col("term").alias("__t2"), F.col("pos").alias("__p"), F.floor(F.col("pos") / reach).alias("__b2"))
    on = (F.col("uid") == F.col("__u")) & (F.col("__t") == F.col("__t2")) & (F.col("__b") == F.col("__b2")) & (F.abs(F.col("pos") - F.col("__p")) <= reach)
    met = wide.join(near, on, "left_semi").groupBy("uid", "win", "pos").agg(F.count_distinct("__t").alias("__n"))
    some = anchor.join(F.broadcast(need), "win", "left").where("__need is null").select("uid", "win", "pos")
    return some.unionByName(met.join(F.broadcast(need), "win").where("__n = __need").select("uid", "win", "pos"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more)."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark)
    index = build_index(docs, windows)
    per_doc = index.where("term is null").select("uid", "doc_id", "n_words")
    terms = ranked_windows(spark, index, windows)
    found = durable(phrase_matches(index, terms), "phrases")
    covered = found.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct()
    hits = covered.groupBy("uid").agg(F.count("*").alias("n_hit"))
    number = {w: k for k, w in enumerate(dict.fromkeys(w for _, w in windows))}
    owners = spark.createDataFrame([(number[w], i) for i, w in windows], "win int, item string")
    items = found.select("uid", "win").distinct().join(F.broadcast(owners), "win").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = per_doc.join(hits, "uid", "left").join(items, "uid", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.size(listed) >= 2).alias("contaminated"), "uid")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs; windows and words are those of ``contamination``."""
    reserve(docs, "__uid")
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark)
    rows = durable(docs.withColumn("__uid", F.monotonically_increasing_id()), "decontam-rows")  # ids are no keys: they repeat
    index = build_index(rows, windows, uid="__uid")
    bad = phrase_matches(index, ranked_windows(spark, index, windows)).select(F.col("uid").alias("__uid")).distinct()
    return rows.join(bad, "__uid", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
with d as (select doc_id, coalesce({_WORDS}, []::varchar[]) as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null and text is not null),
win as (select distinct item, list_slice(w, i, i + 7) as g, len(list_slice(w, i, i + 7)) as size
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 7))) as i from b where len(w) > 0)),
grams as (select doc_id, p, size, list_slice(w, p, p + size - 1) as g
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as p
    from d cross join (select distinct size from win) where len(w) >= size)),
hit as (select doc_id, item, p, grams.size as size from grams join win on grams.size = win.size and grams.g = win.g),
cov as (select doc_id, count(distinct q) as n_hit
  from (select doc_id, unnest(generate_series(p, p + size - 1)) as q from hit) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join cov using (doc_id) left join it using (doc_id)
"""
