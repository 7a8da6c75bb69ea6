"""SimHash near-duplicates by anchor-point covering.

Fingerprints are joined at a Hamming distance of ``THRESHOLD`` = 2.  The anchors are the words of a covering code: the
direct sum of two perfect binary Golay codes [23,12] over the first 46 bits (covering radius 3 each), with the other
bits free.  Each fingerprint is at home at its one nearest anchor and is replicated to every anchor within covering
radius plus threshold (per block, the excess over the radius sums to at most 2): about 61 anchors each.  If x and y
differ in at most 2 bits, y reaches the home of x, so one equi-join on the anchor finds every link, and an exact
``bit_count(xor)`` decides it.  Work is on distinct fingerprints: copies collapse before anything is replicated.

The pipeline's stage ``near_dedup`` links by its own rule, an exact Jaccard similarity of 5-word shingle sets.  SimHash
fingerprints of these sets, joined by the same covering, give its first candidates and settle most near copies.  Two
texts may reach that similarity with fingerprints further apart than any covering could join, so prefix filtering
(Chaudhuri et al., 2006) then finds every other pair that can reach it.  No pair is left out by its fingerprints.

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any other; a very long text is
hashed whole, its bits counted by pieces of 65,536 shingles; repeated rows get a row each; a null doc_id is never a
component id unless no id of its group is known (then null); an empty table gives an empty result; extra columns are not
read, and pass through ``near_dedup`` but for ``__row``, which is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import connected_components, discard, durable, release, reserve, small_batches, table

THRESHOLD = 2
SHINGLE = 3
NEAR_SHINGLE, NEAR = 5, (4, 5)  # words of a shingle, and Jaccard similarity as a fraction, of the pipeline's stage
ORDER_TERMS = 500_000
COUNTED = 1 << 22  # shingles that a task counts together before it passes them on
PASSES = 4  # parts of all keys that are shuffled one after another, which bounds the disk that lists take
BLOCKS = (0, 23)  # where each Golay block starts
BLOCK_BITS = 23
_GOLAY = 0b101011100011  # generator polynomial of the perfect [23,12] code


def text_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words; of all words if there are fewer; none for none."""
    words = raw.lower().split()  # bytes: only A-Z change, and white space is \x20 \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """One 64-bit fingerprint for each list: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for i, h in enumerate(hashes):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 65_536):  # a very long text goes by pieces
            part = np.array(h[at : at + 65_536], dtype=np.uint64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16 if len(part) < 65_536 else np.int64)
        if len(h):
            out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [text_hashes(t.encode()) if t else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(hashes).view(np.int64))], names=["doc_id", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each byte of a word, and for each syndrome the error patterns of weight up to 3, 4 and 5."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _GOLAY << (i - 11)
        return x

    single = [remainder(1 << i) for i in range(BLOCK_BITS)]
    by_byte = np.zeros((3, 256), dtype=np.int64)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < BLOCK_BITS:
                    by_byte[k, v] ^= single[8 * k + i]
    patterns: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(3)]
    level = [(0, 0, -1)]
    for weight in range(6):
        for word, syndrome, _ in level:
            patterns[max(0, weight - 3)][syndrome].append(word)
        level = [(w | 1 << i, s ^ single[i], i) for w, s, last in level for i in range(last + 1, BLOCK_BITS)]
    return by_byte, [[np.array(p, dtype=np.int64) for p in of] for of in patterns]


_TABLES: list = []


def covering_anchors(fp: int) -> tuple[int, np.ndarray]:
    """The home anchor of a fingerprint and all anchors within covering radius plus threshold."""
    if not _TABLES:
        _TABLES.extend(_syndromes())
    by_byte, patterns = _TABLES
    near = []
    for at in BLOCKS:
        x = fp >> at & (1 << BLOCK_BITS) - 1
        s = int(by_byte[0, x & 255] ^ by_byte[1, x >> 8 & 255] ^ by_byte[2, x >> 16])
        near.append([(x ^ patterns[e][s]) << at for e in range(THRESHOLD + 1)])
    first, second = near
    parts = [np.bitwise_or.outer(first[a], second[b]).ravel() for a in range(THRESHOLD + 1) for b in range(THRESHOLD + 1 - a)]
    return int(first[0][0] | second[0][0]), np.concatenate(parts)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy()
        for at in range(0, len(fps), 2048):
            part = fps[at : at + 2048]
            anchors = [covering_anchors(int(x) & (1 << 64) - 1)[1] for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.repeat(part, [len(a) for a in anchors]))], names=["anchor", "fp"])


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        home = np.array([covering_anchors(int(x) & (1 << 64) - 1)[0] for x in b.column(0).to_numpy()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(home), b.column(0)], names=["anchor", "home"])


def near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column ``fp``) that differ in at most 2 bits."""
    fps = distinct.select("fp")
    visits, homes = fps.mapInArrow(_replicate, "anchor long, fp long"), fps.mapInArrow(_home, "anchor long, home long")
    joined = visits.join(homes, "anchor").where((F.col("home") < F.col("fp")) & (F.bit_count(F.col("home").bitwiseXOR(F.col("fp"))) <= THRESHOLD))
    return joined.select(F.col("home").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``docs`` (doc_id, text)."""
    marked = durable(fingerprint_table(docs), "simhash-fp")
    spark = docs.sparkSession
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = connected_components(near_pairs(distinct.repartition(parts, "fp")))
    merged = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    low = merged.withColumn("component", F.coalesce("component", "fp")).select("fp", "component", "low")
    ids = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(ids, "component").select("fp", "component_id")
    # few fingerprints of an ordinary corpus are shared, but one may be by a third of it: rows are joined by salt
    salts = 16
    many = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(many, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def _shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's shingles of ``NEAR_SHINGLE`` words, in ascending order."""
    return np.unique(np.array(text_hashes(text.encode(), NEAR_SHINGLE) if text else [], dtype=np.uint64).view(np.int64))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [_shingle_set(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])


def _sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's buckets (Mitzenmacher et al., 2014), a power of two of at least a bit per member.

    Two sets differ in at least as many members as their sketches do in bits; the halves of one fold into a shorter one.
    """
    m = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (m - 1), minlength=m) & 1, bitorder="little").view(np.int64)


def _common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Heads of the shingle hashes that most rows hold, in ascending order, the rows that hold them, and bits cut off.

    All rows are counted, so that what is common in a larger table is seen there too; counts only order prefixes.
    Heads of 38 to 44 bits are dealt into buckets by their upper bits, and 32 bits of each are shuffled as packed arrays.
    """
    spark = rows.sparkSession
    upper = min(12, max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    cut = 32 - upper

    def packed(sets: list[np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(sets).view(np.uint64) >> np.uint64(cut), return_counts=True)
        edges = np.searchsorted(u, np.arange((1 << upper) + 1, dtype=np.uint64) << np.uint64(32))
        u, c, found = u.astype(np.uint32), c.astype(np.uint32), []
        for bucket in np.flatnonzero(edges[1:] > edges[:-1]):
            part, n = u[edges[bucket] : edges[bucket + 1]], c[edges[bucket] : edges[bucket + 1]]
            found.append((int(bucket), part[n == 1].tobytes(), part[n > 1].tobytes(), n[n > 1].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=["bucket", "once", "more", "times"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.int64)], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(_shingle_set(text))
                size += len(held[-1])
                if size >= COUNTED:
                    yield packed(held)
                    held, size = [np.zeros(0, np.int64)], 0
        yield packed(held)

    def add(part: pa.Table) -> pa.Table:
        once, more, times = (np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint32) for x in ("once", "more", "times"))
        u, at = np.unique(np.concatenate((once, more)), return_inverse=True)
        n = np.bincount(at, np.concatenate((np.ones(len(once)), times)), len(u)).astype(np.int64)
        h = u[n >= 3].astype(np.int64) | part.column("bucket")[0].as_py() << 32
        return pa.table({"h": h, "n": n[n >= 3]})

    small_batches(spark)
    dealt = rows.select("text").mapInArrow(scan, "bucket int, once binary, more binary, times binary")
    counts = durable(dealt.groupBy("bucket").applyInArrow(add, "h long, n long"), "near-common")
    release(spark)
    least, room = 3, ORDER_TERMS
    for n, many in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        if many > room:
            least = n + 1
            break
        room -= many
    found = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    h, n = found.column("h").to_numpy().astype(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order], cut


def _prefixes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, at, d1, d2, n, fp, sketch, keys): digest, size, fingerprint, sketch and prefix of each row's shingle set.

    ``at`` is the row's key in ``rows``; ``row`` is a number for it.

    Two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each, whatever the one order
    of shingles that all sets are sorted by.  Common ones come last here, so that the lists of keys stay short, and keys
    are in that order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common_shingles(rows))  # bounded by ORDER_TERMS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, cut = shared.value
        for b in batches:
            digests, sizes, keys, fps, sketches = [], [], [], [], []
            for text in b.column(3).to_pylist():
                h = _shingle_set(text)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                fps.append(fingerprints([h.view(np.uint64)])[0])
                sketches.append(_sketch(h))
                if len(known):
                    head = h.view(np.uint64) >> np.uint64(cut)
                    at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                    h = h[np.lexsort((h, np.where(known[at] == head, often[at], 0)))]
                keys.append(h[: len(h) - -(-len(h) * NEAR[0] // NEAR[1]) + 1])
            d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketches, keys)]
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int32()), fp, *lists], names=["row", "doc_id", "at", "d1", "d2", "n", "fp", "sketch", "keys"])

    small_batches(rows.sparkSession)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("at"), "text")
    found = numbered.mapInArrow(scan, "row long, doc_id long, at binary, d1 long, d2 long, n int, fp long, sketch array<long>, keys array<long>")
    return durable(found, "near-prefixes")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]


def _may_be_similar(a: Column, b: Column) -> Column:
    """Whether two structs (n, sketch) allow a similarity of ``NEAR``: a bound, so that no pair which has it is lost."""

    def folded(x: Column, y: Column) -> Column:
        half = F.size(y["sketch"])
        halves = F.zip_with(F.slice(x["sketch"], F.lit(1), half), F.slice(x["sketch"], half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x["sketch"]) > half, halves).otherwise(x["sketch"])

    apart = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    differ = F.aggregate(apart, F.lit(0).cast("long"), lambda x, y: x + y)
    return _sizes_fit(a["n"], b["n"]) & (differ * (NEAR[0] + NEAR[1]) <= (a["n"] + b["n"]) * (NEAR[1] - NEAR[0]))


def _similar(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes whose shingle sets have a Jaccard similarity of ``NEAR`` or more.

    Sketches, a 64th to a 32nd of the sets, leave the pairs that may have it; whole sets decide on these.
    """
    drawn = lambda x: nodes.select(F.col("node").alias(x), F.struct("n", "sketch").alias(f"s{x}"))
    maybe = pairs.join(drawn("b"), "b").join(drawn("a"), "a").where(_may_be_similar(F.col("sa"), F.col("sb")))
    close = durable(maybe.select("a", "b").distinct(), "near-close")
    release(rows.sparkSession)
    asked = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
    places = nodes.join(asked, "node", "left_semi").select("node", F.col("low.at").alias("__row"))
    texts = rows.select("__row", "text").join(places, "__row").select("node", "text").dropDuplicates(["node"])
    sets = durable(texts.mapInArrow(_set_batches, "node long, h array<long>"), "near-sets")
    release(rows.sparkSession)
    held = lambda x: sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"))
    both = F.size(F.array_intersect("ha", "hb"))
    found = []
    for k in range(PASSES):  # pairs carry sets, so they go one part after another
        wide = close.where(F.pmod(F.xxhash64("a"), F.lit(PASSES)) == k).join(held("b"), "b").join(held("a"), "a")
        found.append(durable(wide.where(both * (NEAR[0] + NEAR[1]) >= (F.size("ha") + F.size("hb")) * NEAR[0]).select("a", "b"), "near-links"))
        release(rows.sparkSession)
    discard(close)
    discard(sets)
    return reduce(DataFrame.unionByName, found)


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of a size that fits whose fingerprints link.  Nodes of one fingerprint meet its smallest."""
    heads = durable(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")), "near-heads")
    same = nodes.select("fp", F.struct("node", "n").alias("to")).join(heads, "fp").where("to.node <> head.node")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = near_pairs(heads.repartition(parts, "fp"))
    named = linked.join(heads.select(F.col("fp").alias("a"), "head"), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("to")), "b")
    met = same.select("head", "to").unionByName(named.select("head", "to")).where(_sizes_fit(F.col("head.n"), F.col("to.n")))
    return met.select(F.least("head.node", "to.node").alias("a"), F.greatest("head.node", "to.node").alias("b"))


def similar_sets(rows: DataFrame) -> DataFrame:
    """(component, doc_id, at): for each group of rows linked by similar shingle sets, its smallest doc_id and key ``__row``.

    Equal sets are one node.  Nodes whose fingerprints link are compared first.  Of the others, every node is compared
    with one node, the hub, on the list of each of its keys, unless they are in one component already, which settles
    groups of near copies with a number of comparisons in proportion to their size; then all pairs on a list that are
    in different components yet are compared.  A link is only made by the exact similarity.

    The first shingle that two sets share has a place in each, and no shingle before it is in both: from there on must
    be all that they share (Xiao et al., 2008).  So a key at place p of a set of n shingles only serves for partners of
    up to ``cap`` = (n / t) - (1 + 1 / t) p shingles, and nodes for which their list has no such partner leave it.  The
    hub has its key at the earliest place: it has the fewest shingles that others lack.
    """
    marked = _prefixes(rows)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("low")
    same = [F.min("n").alias("n"), F.min("fp").alias("fp"), F.any_value("sketch").alias("sketch")]  # equal for equal sets
    nodes = durable(marked.groupBy("d1", "d2").agg(F.min("row").alias("node"), low, *same).drop("d1", "d2"), "near-nodes")
    release(rows.sparkSession)
    links = _similar(rows, nodes, _fingerprint_pairs(nodes))
    copies = connected_components(links)
    listed = []
    for k in range(PASSES):
        placed_keys = F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("place")))
        keys = marked.select(F.col("row").alias("node"), "n", F.filter(placed_keys, lambda x: F.pmod(x["key"], F.lit(PASSES)) == k).alias("keys"))
        own = keys.join(nodes.select("node"), "node", "left_semi").select(F.explode("keys").alias("k"), "node", "n")
        own = own.select("k.key", "k.place", "node", "n", F.expr(f"(n * {NEAR[1]} - k.place * {sum(NEAR)}) div {NEAR[0]}").alias("cap"))
        first = own.groupBy("key").agg(F.min(F.struct("place", "node", "n", "cap")).alias("first"), F.min("n").alias("__n"), F.max("cap").alias("__cap"), F.count("*").alias("__c")).where("__c > 1")
        fits = (F.col("cap") >= F.col("__n")) & (F.col("n") <= F.col("__cap"))
        listed.append(durable(own.join(first, "key").where(fits).select("key", "node", "n", "cap", "first"), "near-lists"))
        release(rows.sparkSession)
    lists = reduce(DataFrame.unionByName, listed)
    discard(marked)
    star = lists.where((F.col("node") != F.col("first.node")) & (F.col("n") <= F.col("first.cap")) & (F.col("first.n") <= F.col("cap")))
    star = star.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b")).distinct()
    for x in ("a", "b"):
        star = star.join(copies.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    apart = star.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.unionByName(_similar(rows, nodes, apart))
    linked = connected_components(links)
    placed = lists.join(linked, "node", "left").select("key", "node", "n", "cap", F.coalesce("component", "node").alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("__a"), F.max("c").alias("__b")).where("__a < __b").select("key")
    placed = durable(placed.join(open_keys, "key", "left_semi"), "near-open")
    for part in listed:
        discard(part)
    groups = placed.groupBy("key", "c").agg(F.min("n").alias("n"), F.max("cap").alias("cap"))
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "key"])
    fit = (F.col("n_a") <= F.col("cap_b")) & (F.col("n_b") <= F.col("cap_a"))  # of two nodes, or some of two groups
    met = side(groups, "a").join(side(groups, "b"), "key").where((F.col("c_a") < F.col("c_b")) & fit).select("key", "c_a", "c_b")
    cross = met.join(side(placed, "a"), ["key", "c_a"]).join(side(placed, "b"), ["key", "c_b"]).where(fit)
    cross = cross.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    links = links.unionByName(_similar(rows, nodes, cross))
    discard(placed)
    found = nodes.join(connected_components(links), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("low").alias("low"))
    found = durable(found.select("component", "low.doc_id", "low.at"), "near-found")
    discard(nodes)
    return found


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document, that of the smallest id, of each group of near-duplicates.

    Near-duplicates are documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and all that
    such links connect; documents without words are one group.  Rows are told apart by a digest of id and text, not by
    ``doc_id``, and the one of the smallest (doc_id, digest) stays, a null id last; of rows equal in both, any one.
    Texts are read from ``docs`` again wherever they are needed, and no copy of them is written.
    """
    reserve(docs, "__row")
    whole = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__row", F.unhex(F.md5(whole)))
    keep = similar_sets(rows).select(F.col("at").alias("__row"))
    return rows.dropDuplicates(["__row"]).join(keep, "__row", "left_semi").select(docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
