"""Exact removal of repeated byte strings of at least ``LENGTH`` bytes.

A byte goes if a ``LENGTH``-byte string over it also starts earlier (smaller doc_id, or same document, earlier start).

1. Every window of ``LENGTH`` bytes is assigned to its anchor, the leftmost of its ``K``-byte grams of least hash;
   consecutive windows of one anchor position form a run (at most ``LENGTH + LENGTH - K`` bytes).  Equal windows have
   equal anchors, so an anchor hash that occurs once in the corpus needs no more work.  Only hashes and positions are
   shuffled here.
2. Runs of a repeated anchor are grouped by a hash of their bytes: all but the earliest of equal runs go as a whole.
   The earliest of each are compared with the other runs of their anchor where there is more than one.
3. For those alone the bytes are fetched.  Blocks of whole anchor groups are joined into one text, and breadth-first
   backward extension on its Burrows-Wheeler transform (Beller et al., 2013) sets common-prefix values in increasing
   order; it stops at ``LENGTH``, when the places not yet reached are exactly those of repeated windows.
4. A group of over ``HOT`` different runs is split before that: windows are parted by where the anchor lies in them,
   into ever fewer places, and regrouped by all the bytes that windows of such a part have in common.  Equal windows
   stay together at each level; at the last one, a single place, the common bytes are the whole window.

Rows are told apart by their doc_id and 89 bits of hashes of their text, which cost the shuffles nothing: rows that
agree in both are repeated rows.

Defined results: null and empty texts have no bytes; a very long text is scanned by pieces of 1 MiB that overlap by a
window, up to Spark's own limit of 2 GiB; rows that share a doc_id are judged as one document by position (neither of
two rows at the same start is earlier), so repeated rows get equal results; a null id is the smallest; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, durable, join_small, release, small_batches, table

LENGTH, K = 100, 32
HOT = 4000
BLOCK_BYTES = 1 << 20
PIECE = (1 << 20) - 4096
NULL_ID = -(1 << 63)
PLACES = LENGTH - K + 1  # of an anchor in a window
SHARED = 20_000  # rows of one run that a task joins
N_BITS, POS_BITS, X_BITS = 7, 31, 25  # of ``at``: windows of a run, its first window, more bits of the text's hash
KEY = ["doc", "t", "x"]


def gram_hashes(raw: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-byte gram, by doubling."""
    h = raw.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(12345)
    n, step = 1, 0x9E3779B97F4A7C15
    while n < k:
        d = min(n, k - n)
        h = h[:-d] * np.uint64(step) + h[d:]
        h ^= h >> np.uint64(29)
        n, step = n + d, step * step % (1 << 64) | 1
    return h * np.uint64(0xD6E8FEB86659FD93)


def anchor_runs(raw: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of consecutive windows with one anchor position."""
    width, whole = length - k + 1, np.frombuffer(raw, np.uint8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        h = gram_hashes(whole[at : at + PIECE + length - 1], k)
        m = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while n < width:
            d = min(n, width - n)
            m = np.minimum(m[:-d], m[d:])
            n += d
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        gram = h[(m[first] & np.uint64((1 << 20) - 1)).astype(np.int64)]
        out.append((gram, first + at, np.diff(np.append(first, len(m)))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols 0 to 257) in the order of their first ``depth`` symbols, and their places."""
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits a symbol
        key = key << np.uint64(9) | padded[j : j + n]
    order, span = np.argsort(key, kind="stable"), 7
    rank = np.empty(n, np.int64)
    new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
    rank[order] = np.cumsum(new)
    while span < depth and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], pair[order][1:] != pair[order][:-1])))
        span *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of the ``length``-byte windows that occur at two places or more of the strings."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]) + 1, np.int16)  # ends in a symbol of its own, so rotations sort as suffixes
    text[:-1] = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int16) + 2
    text[ends - 1] = 1
    n = len(text)
    order, place = suffix_array(text, length + 1)
    head = text[order]
    back = place[order - 1]  # where a row goes when its text is extended by the symbol before it
    reached = np.zeros(n + 1, bool)  # common-prefix value with the row before is set, and below length
    reached[0] = reached[n] = True
    low, high = np.array([0]), np.array([n - 1])
    mark = np.zeros(n + 2, np.int64)
    stamp = 0
    for _ in range(length):
        sizes_now = high - low + 1
        total = int(sizes_now.sum())
        if not total:
            break
        starts = np.cumsum(sizes_now) - sizes_now
        rows = np.arange(total) + np.repeat(low - starts, sizes_now)
        to = back[rows]
        owner = np.repeat(np.arange(len(low)) + stamp + 1, sizes_now)
        stamp += len(low)
        mark[to + 1] = owner
        last = (mark[to + 2] != owner) | (head[np.minimum(to + 1, n - 1)] != head[to])
        first = (mark[to] != owner) | (head[np.maximum(to - 1, 0)] != head[to])
        new_high, new_low = np.sort(to[last]), np.sort(to[first])
        fresh = ~reached[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        reached[high + 1] = True
    same = ~reached[:n]
    same[0] = False
    run = np.cumsum(~same)  # rows with a common prefix of length or more
    member = same | np.append(same[1:], False)
    at = order[member]
    string = np.searchsorted(ends, at, side="right")
    offset = at - (ends[string] - sizes[string] - 1)
    inside = offset + length <= sizes[string]
    return string[inside], offset[inside], run[member][inside]


def named_texts(docs: DataFrame) -> DataFrame:
    """(doc, t, x, text): what tells rows apart, in the order of the documents."""
    more = F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 64 - X_BITS)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("t"), more.alias("x"), "text")


def _start(at: str = "at"):
    return F.shiftright(at, N_BITS).bitwiseAND((1 << POS_BITS) - 1)


def _spans(rows: DataFrame) -> DataFrame:
    """(doc, t, x, start, stop) of the runs of rows (doc, t, at)."""
    stop = _start() + F.col("at").bitwiseAND((1 << N_BITS) - 1) + F.lit(LENGTH - 1)
    return rows.select("doc", "t", F.shiftright("at", N_BITS + POS_BITS).alias("x"), _start().alias("start"), stop.alias("stop"))


def _packed(x: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x << N_BITS + POS_BITS | pos.astype(np.int64) << N_BITS | n.astype(np.int64)


def _runs_table(docs: DataFrame) -> DataFrame:
    """(g, s, doc, t, at): anchor hash, hash of the run's bytes, text, and where the run lies in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, s, which, at = [], [], [], []
            for i, (x, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                raw = text.encode() if text else b""
                if len(raw) < LENGTH:
                    continue
                gram, first, n = anchor_runs(raw)
                stop = (first + n + LENGTH - 1).tolist()
                s.append(np.fromiter((xxhash.xxh3_64_intdigest(raw[u:v]) for u, v in zip(first.tolist(), stop, strict=True)), np.uint64, len(first)))
                g.append(gram)
                which.append(np.full(len(first), i))
                at.append(_packed(x, first, n))
            if g:
                rows = np.concatenate(which)
                cols = [np.concatenate(g).view(np.int64), np.concatenate(s).view(np.int64), b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows], np.concatenate(at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "s", "doc", "t", "at"])

    return docs.mapInArrow(scan, "g long, s long, doc long, t long, at long")


_RUN = "g long, s long, doc long, t long, at long, run binary"


def _fetch(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The asked runs with their bytes; ``asked`` has a row for each text with a list of (g, s, at)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for d, t, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode() if text else b""
                for r in wanted:
                    pos = r["at"] >> N_BITS & (1 << POS_BITS) - 1
                    for c, v in zip(cols, (r["g"], r["s"], d, t, r["at"], raw[pos : pos + (r["at"] & (1 << N_BITS) - 1) + LENGTH - 1]), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "s", "doc", "t", "at", "run"])

    return docs.join(asked, KEY).select("doc", "t", "text", "wanted").mapInArrow(take, _RUN)


def split_run(g: int, run: bytes, n: int, level: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(group, hash, first window, windows, bytes) of the parts of a run; places of the anchor are parted 2^level ways."""
    grams = gram_hashes(np.frombuffer(run, np.uint8)[: PLACES + K - 1])
    anchor = int(np.flatnonzero(grams == np.uint64(g & (1 << 64) - 1))[0])
    width = -(-PLACES // (1 << level))
    least, most = anchor - n + 1, anchor  # places of the anchor in the run's windows
    for part in range(least // width, most // width + 1):
        low, high = part * width, part * width + width - 1
        common = run[anchor - low : anchor - high + LENGTH]
        first, last = anchor - min(high, most), anchor - max(low, least)
        own = run[first : last + LENGTH]
        group = xxhash.xxh3_64_intdigest((g & (1 << 64) - 1).to_bytes(8, "little") + common, part << 3 | level)
        yield group, xxhash.xxh3_64_intdigest(own), first, last - first + 1, own


def _split(rows: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for top, d, t, at, raw in zip(*(b.column(c).to_pylist() for c in ("top", "doc", "t", "at", "run")), strict=True):
                for g, s, first, n, own in split_run(top, raw, at & (1 << N_BITS) - 1, level):
                    moved = (at >> N_BITS) + first << N_BITS | n
                    for c, v in zip(cols, (signed(g), signed(s), d, t, moved, own, top), strict=True):
                        c.append(v)
            kinds = [*[pa.int64()] * 5, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "s", "doc", "t", "at", "run", "top"])

    return rows.select("top", "doc", "t", "at", "run").mapInArrow(run, f"{_RUN}, top long")


def _expand_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor -> (doc, t, x, start, stop) of the repeated windows of each."""
    held: list[tuple[int, int, int, bytes]] = []
    size, group = 0, None

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        string, offset, of = repeated_windows([r[3] for r in rows])
        doc, t, at = (np.array([r[i] for r in rows], dtype=np.int64)[string] for i in range(3))
        pos, x = (at >> N_BITS & (1 << POS_BITS) - 1) + offset, at >> N_BITS + POS_BITS
        by = np.lexsort((pos, doc, of))
        doc, t, x, pos, of = doc[by], t[by], x[by], pos[by], of[by]
        starts = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(starts, np.arange(len(of)), 0)) if len(of) else starts.astype(np.int64)
        later = (doc != doc[lead]) | (pos != pos[lead])
        doc, t, x, pos = doc[later], t[later], x[later], pos[later]
        by = np.lexsort((pos, x, t, doc))
        doc, t, x, pos = doc[by], t[by], x[by], pos[by]
        cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (pos[1:] > pos[:-1] + 1))) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(doc)) - 1 if len(first) else first
        cols = [doc[first], t[first], x[first], pos[first], pos[last] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "t", "x", "start", "stop"])

    for b in batches:
        for g, doc, t, at, run in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if g != group and size > BLOCK_BYTES:
                yield solve(held)
                held, size = [], 0
            group = g
            held.append((doc, t, at, run))
            size += len(run) + 1
    if held:
        yield solve(held)


_SPAN = "doc long, t long, x long, start long, stop long"


def _place(*more: str):
    return F.struct("doc", _start().alias("pos"), "t", "at", *more)


def _copies(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Spans of the runs that aren't the earliest of theirs; a run that very many rows have is dealt over tasks."""
    shared = first.where(F.col("c") > SHARED).select("g", "s", F.ceil(F.col("c") / SHARED).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    left = join_small(rows.select("g", "s", "doc", "t", "at"), shared, ["g", "s"], "left").withColumn("__salt", F.pmod(F.xxhash64("doc", "t", "at"), salts).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / SHARED).cast("int") - 1))
    right = first.select("g", "s", F.col("f.doc").alias("d0"), F.col("f.pos").alias("p0"), every.alias("__salt"))
    return _spans(left.join(right, ["g", "s", "__salt"]).where((F.col("doc") != F.col("d0")) | (_start() != F.col("p0"))))


def _expanded(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("g", "doc", "t", "at", "run").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_expand_blocks, _SPAN)


def repeated_spans(docs: DataFrame) -> dict[str, DataFrame]:
    """(doc, t, x, start, stop) of spans that hold only bytes to remove, for docs (doc, t, x, text), by how they are found."""
    spark = docs.sparkSession
    small_batches(spark)
    runs = durable(_runs_table(docs), "suffix-runs")
    often = runs.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    often = durable(often, "suffix-often")
    release(spark)
    several = durable(runs.join(often, "g", "left_semi"), "suffix-several")
    discard(often)
    discard(runs)
    first = durable(several.groupBy("g", "s").agg(F.min(_place()).alias("f"), F.count("*").alias("c")), "suffix-first")
    mixed = first.groupBy("g").agg(F.count("*").alias("of")).where("of > 1")
    sized = first.select("g", "s", "f.*").join(mixed, "g")
    asked = sized.groupBy("doc", "t", F.shiftright("at", N_BITS + POS_BITS).alias("x")).agg(F.collect_list(F.struct("g", "s", "at")).alias("wanted"))
    fetched = durable(_fetch(durable(asked, "suffix-asked"), docs), "suffix-bytes")
    release(spark)
    hot = durable(mixed.where(F.col("of") > HOT).select("g"), "suffix-hot")
    found = {"copies": _copies(several, first)}
    if hot.isEmpty():
        return found | {"expansion": _expanded(fetched)}
    found["expansion"] = _expanded(fetched.join(hot, "g", "left_anti"))
    rows = fetched.join(hot, "g", "left_semi").withColumn("top", F.col("g"))
    for level in range(1, (PLACES - 1).bit_length() + 1):
        parts = durable(_split(rows, level), "suffix-parts")
        first = durable(parts.groupBy("g", "s").agg(F.min(_place("run", "top")).alias("f"), F.count("*").alias("c")), "suffix-first")
        found["copies"] = found["copies"].unionByName(_copies(parts, first))
        sized = durable(first.groupBy("g").agg(F.count("*").alias("of")).where("of > 1"), "suffix-sizes")
        here = first.select("g", "s", "f.*").join(sized, "g")
        found["expansion"] = found["expansion"].unionByName(_expanded(here.where(F.col("of") <= HOT)))
        if sized.where(F.col("of") > HOT).isEmpty():
            break
        rows = here.where(F.col("of") > HOT)
    return found


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, spans array<(start, stop)>) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    named = named_texts(docs)
    found = repeated_spans(named)
    spans = durable(found["copies"].unionByName(found["expansion"]).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kept, sizes, gone = [], [], [], []
            for d, t, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode() if t else b""
                merged = _union(found)
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                ids.append(None if d == NULL_ID else d)
                sizes.append(len(raw))
                gone.append([{"start": x, "stop": y} for x, y in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, kind)], names=["doc_id", "kept", "n_bytes", "spans"])

    return named.join(spans.hint("shuffle_hash"), KEY, "left").select("doc", "text", "spans").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, spans array<struct<start:long,stop:long>>")


def op10_frame(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_frame(table(spark, sf_dir, "documents"))
