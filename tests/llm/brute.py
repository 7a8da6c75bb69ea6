"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

import numpy as np
import xxhash

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the farm. " * 4, "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm. " * 4, "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (4, "   \t\n ", None, "b"),
    (5, "one", "fr", "b"),
    (6, "Ünïcödé text: naïve café — 東京 " * 9, "fr", "b"),
    (7, "x" * 350, "en", "c"),
    (8, ("lorem ipsum dolor sit amet consectetur " * 200), "en", "c"),
    (8, ("lorem ipsum dolor sit amet consectetur " * 200), "en", "c"),
    (9, "intro. " + "The quick brown fox jumps over the lazy dog and runs away from the farm. " * 4 + "tail", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (11, "ONE", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id as uid", "source as term", "1 as n", "0 as component") if extra else df


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, limit=2):
    """Smallest id reachable, for (doc_id, fingerprint) rows."""
    fp = np.array([f for _, f in fps], dtype=np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= limit):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(fps))]


def without_repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each (doc_id, text)."""
    seen, raws = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            at = (-1 if d is None else d, i)
            w = raw[i : i + length]
            seen[w] = min(seen.get(w, at), at)
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] < (-1 if d is None else d, i):
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
