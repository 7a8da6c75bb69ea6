import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlake.llm import ann, chat, common, decontam, mixing, quality, sharding, simhash, suffix_dedup, tokenfile, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ORDER = lambda rows: sorted(rows, key=repr)


# sharding


def test_communication_matrix_is_exact():
    counts = [7, 0, 500, 3, 41]
    m = sharding.communication_matrix(counts, 24, 1)
    assert m.sum(1).tolist() == counts and m.sum(0).max() - m.sum(0).min() <= 1
    assert (sharding.communication_matrix(counts, 24, 1) == m).all()


def test_hypergeometric_of_huge_tables():
    got = sharding.hypergeometric(np.random.default_rng(1), 3_000_000_000, 5_000_000_000, 80_000)
    assert abs(got - 30_000) < 1000


def test_sharding_of_whole_table(spark):
    rows = sharding.op1_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_of_odd_rows(spark):
    docs = brute.documents(spark)
    out = sharding.shard_documents(docs, 4)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert ORDER(map(tuple, out.select(docs.columns).collect())) == ORDER(map(tuple, docs.collect()))
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0
    placed = sharding.deal(common.durable(spark.range(500).withColumnRenamed("id", "__uid"), "t"), 6, partitions=9).collect()
    assert sorted((r["shard"], r["slot"]) for r in placed) == sorted((s, i) for s in range(6) for i in range(84 if s < 2 else 83))
    with pytest.raises(ValueError):
        sharding.shard_documents(docs.withColumn("Shard", F.lit(1)), 4)


# SimHash


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = [*brute.ROWS]
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(1, 400))
        rows.append((100 + 2 * i, " ".join(words), "en", "s"))
        words[rng.randrange(len(words))] = "changed"
        rows.append((101 + 2 * i, " ".join(words).upper(), "en", "s"))
    got = simhash.near_duplicates(brute.documents(spark, rows)).collect()
    fps = [(r[0], brute.fingerprint(r[1])) for r in rows]
    want = [(d, f, c) for (d, f), c in zip(fps, brute.components(fps))]
    assert ORDER((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == ORDER(want)


def test_simhash_finds_every_link_within_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({x ^ m for x in base for m in (0, 1 << rng.randrange(64), 1 << rng.randrange(64) | 1 << rng.randrange(64))})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_pairs(spark.createDataFrame(signed, "fp long")).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = brute.documents(spark)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[8] == 1 and ids[2] == 1 and ids[3] == 0 and ids[6] == 1
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def jaccard_groups(texts, width=5):
    """Smallest row of each text's group, by comparing the sets of all pairs."""

    def grams(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_dedup_links_by_jaccard_of_five_words(spark):
    rng = random.Random(11)
    vocab, texts = [f"w{i}" for i in range(3000)], ["", None, "One two", "one TWO"]
    for size, changes in [(200, 2), (200, 4), (60, 1), (30, 1), (9, 1), (200, 5), (200, 6), (1500, 20)] * 4:
        words = rng.choices(vocab, k=size)
        texts.append(" ".join(words))
        for _ in range(4):  # a chain of copies, so that links past the first of a group count
            for at in rng.sample(range(size), changes):
                words[at] = rng.choice(vocab)
            texts.append(" ".join(words))
    root = jaccard_groups(texts)
    assert len(set(root)) < 0.8 * len(texts)
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert ORDER((r["doc_id"],) for r in got.collect()) == ORDER((r,) for r in set(root))


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(3, text("x")), (5, text("x")), (5, text("y")), (None, text("p")), (None, text("q")), (None, text("y")), (None, text("q"))]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert ORDER(map(tuple, got)) == ORDER([(3, text("x")), (5, text("y")), (None, text("p")), (None, text("q"))])


def test_near_dedup_writes_no_texts_and_few_sets(spark, monkeypatch):
    rng = random.Random(17)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    passages = [fresh(40) for _ in range(20)]
    texts = [f"{fresh(80)} {passages[i % 20]}" for i in range(100)]  # five texts share a passage, a similarity of 0.2
    texts += [f"{t} more" for t in texts[:3]]
    written = []

    def durable(df, label):
        written.append((label, common.durable(df, label)))
        return written[-1][1]

    monkeypatch.setattr(simhash, "durable", durable)
    dropped = []
    monkeypatch.setattr(simhash, "discard", lambda t: dropped.append(t))
    rows = [(i if i % 10 else None, t, "x" * 9) for i, t in enumerate(texts)]
    got = simhash.near_dedup(spark.createDataFrame(rows + rows[:30], "doc_id long, text string, more string"))
    assert not any("text" in t.columns for _, t in written)
    assert 6 <= sum(t.count() for label, t in written if label == "near-sets") <= 18
    left = {label for label, t in written if all(t is not d for d in dropped)}
    assert not left & {"near-prefixes", "near-nodes", "near-lists", "near-close", "near-sets", "near-open"}
    kept = got.collect()
    assert len(kept) == 100 and len({r["text"] for r in kept}) == 100 and len(got.columns) == 3


def test_sketches_bound_the_difference_of_sets(spark):
    rng, rows, want = random.Random(19), [], []
    for size in (1, 2, 5, 40, 63, 64, 65, 70, 128, 129, 140, 1000, 1030, 2500):
        for share in (0.1, 0.5, 0.7, 0.78, 0.8, 0.82, 0.9, 1.0):
            both = {rng.getrandbits(63) for _ in range(round(size * share))}
            a, b = both | {rng.getrandbits(63) for _ in range((size - len(both)) // 2)}, both | {rng.getrandbits(63) for _ in range((size - len(both) + 1) // 2)}
            if a and b:
                rows.append([(len(x), simhash._sketch(np.sort(np.array([*x], dtype=np.int64))).tolist()) for x in (a, b)])
                want.append(5 * len(a & b) >= 4 * len(a | b))
    pair = "n int, sketch array<long>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a struct<{pair}>, b struct<{pair}>")
    a, b = df["a"], df["b"]
    got = df.select("i", simhash._may_be_similar(a, b), simhash._may_be_similar(b, a)).orderBy("i").collect()
    assert all(r[1] == r[2] and (r[1] or not w) for r, w in zip(got, want, strict=True))
    assert sum(r[1] for r in got) < 1.5 * sum(want) + 5


def test_near_dedup_links_simhash_fingerprints_first(spark, monkeypatch):
    rng, seen = random.Random(23), []
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 600))]
        texts += [" ".join(words), " ".join([*words, "end"]), " ".join(words[1:])]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    fps = [int(simhash.fingerprints([[simhash.xxhash.xxh64_intdigest(g, 42) for g in s]])[0]) for s in sets]
    fit = lambda i, j: 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
    of = {frozenset((texts[i], texts[j])) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2 and fit(i, j)}
    first, pairs_of = [], simhash._fingerprint_pairs
    monkeypatch.setattr(simhash, "_fingerprint_pairs", lambda nodes: first.append((nodes.collect(), (p := common.durable(pairs_of(nodes), "t")).collect())) or p)
    near = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda d: seen.append({r["fp"] & (1 << 64) - 1 for r in d.collect()}) or near(d))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_dedup(docs).collect()
    assert seen == [set(fps)]
    (nodes, pairs), = first
    text = {r["node"]: texts[r["low"]["doc_id"]] for r in nodes}
    found = {frozenset((text[r["a"]], text[r["b"]])) for r in pairs}
    assert len(of) > 20 and found <= of and {r["doc_id"] for r in got} == set(jaccard_groups(texts))

    def connected(links):  # pairs go by the smallest node of a fingerprint: what they connect is the same
        root = {t: t for t in texts}
        for x, y in map(tuple, links):
            x, y = root[x], root[y]
            root = {t: min(x, y) if r in (x, y) else r for t, r in root.items()}
        return root

    assert connected(found) == connected(of)


def test_near_dedup_meets_few_pairs_of_a_crowded_passage(spark, monkeypatch):
    rng, met = random.Random(29), []
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(240):  # 4 changes: a similarity of 0.75 to the first and less among themselves, so most stay apart
        words = base[:]
        for at in rng.sample(range(150), 4 if i % 4 else 2):
            words[at] = f"x{rng.getrandbits(40)}"
        texts.append(" ".join(words))
    similar = simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda rows, nodes, pairs: met.append(pairs.count()) or similar(rows, nodes, pairs))
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    root = jaccard_groups(texts)
    assert len(set(root)) > 60 and ORDER((r["doc_id"],) for r in got.collect()) == ORDER((r,) for r in set(root))
    assert sum(met) < 10 * len(texts)


def test_shingles_are_counted_in_all_rows(spark, monkeypatch):
    rng = random.Random(31)
    passages = [[f"w{rng.getrandbits(40)}" for _ in range(20)] for _ in range(30)]
    texts = [" ".join([f"w{rng.getrandbits(40)}" for _ in range(20)] + p) for i, p in enumerate(passages) for _ in range(1 + i % 10)]
    want = Counter(int(h) for t in texts for h in simhash._shingle_set(t).view(np.uint64))
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string").repartition(7)
    monkeypatch.setattr(simhash, "COUNTED", 100)
    h, n, cut = simhash._common_shingles(rows)
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == {x >> cut: c for x, c in want.items() if c >= 3} and h.tolist() == sorted(h.tolist())
    monkeypatch.setattr(simhash, "ORDER_TERMS", 100)  # 3 passages of 16 shingles in 10 texts each, as many in 9 and in 8
    h, n, _ = simhash._common_shingles(rows)
    assert Counter(n.tolist()) == {10: 48, 9: 48}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert common.connected_components(edges.limit(0)).count() == 0


# quality


def test_quality_predicts_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["score"] for r in quality.op3_quality(spark, sf).collect()}
    labels = [(got[r["doc_id"]], r["quality"]) for r in common.table(spark, sf, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]
    assert len(got) == common.table(spark, sf, "documents").count()
    assert all(0 <= s <= 1 for s in got.values())
    assert area(labels) > 0.75


def area(pairs):
    """Share of pairs of either label that the scores order rightly."""
    one, zero = [s for s, y in pairs if y > 0], [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / max(1, len(one) * len(zero))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = brute.documents(spark)
    got = quality.quality_scores(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(brute.ROWS) and all(0 < r["score"] < 1 for r in got)
    none = quality.quality_scores(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(none) == len(brute.ROWS) and all(r["p"] == 0.5 for r in none)
    assert quality.quality_scores(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_toward_what_is_above(spark):
    rows = [(i, "big", "p", 0.9) for i in range(300)] + [(500 + i, "low", "p", 0.1) for i in range(300)] + [(999, "tiny", "p", 0.95)]
    got = quality.site_scores(spark.createDataFrame(rows, "doc_id long, host string, path string, p double"))
    by = {r["host"]: r["host_posterior"] for r in got.collect()}
    assert by["low"] < 0.2 and by["big"] > 0.8 and abs(by["tiny"] - 0.5) < 0.05


def brute_sites(rows):
    """Priors and posteriors of (doc_id, host, path, p), document by document."""
    mean = sum(r[3] for r in rows) / len(rows)
    hosts, paths = {}, {}
    for _, h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    avg = lambda x: sum(x) / len(x)
    v = mean * (1 - mean)
    between = (sum(len(x) * (avg(x) - mean) ** 2 for x in hosts.values()) - (len(hosts) - 1) * v) / (len(rows) - sum(len(x) ** 2 for x in hosts.values()) / len(rows))
    vh = {h: avg(x) * (1 - avg(x)) for h, x in hosts.items()}
    chance = sum((sum(k[0] == h for k in paths) - 1) * vh[h] for h in hosts)
    left = sum(len(x) - sum(len(y) ** 2 for k, y in paths.items() if k[0] == h) / len(x) for h, x in hosts.items())
    inner = (sum(len(x) * (avg(x) - avg(hosts[h])) ** 2 for (h, _), x in paths.items()) - chance) / left
    weight = lambda s, var: min(1000.0, max(1.0, var / max(s, 1e-6) - 1))
    k1, k2 = weight(between, v), weight(inner, sum(len(x) * vh[h] for h, x in hosts.items()) / len(rows))
    logit, out = lambda z: math.log(z / (1 - z)), {}
    for d, h, q, p in rows:
        rest, same = list(hosts[h]), list(paths[h, q])
        for x in same:
            rest.remove(x)
        same.remove(p)
        host = (k1 * mean + sum(hosts[h]) - p) / (k1 + len(hosts[h]) - 1)
        above = (k1 * mean + sum(rest)) / (k1 + len(rest))
        path = (k2 * above + sum(same)) / (k2 + len(same))
        out[d] = (host, path, 1 / (1 + math.exp(-(logit(p) + 0.5 * (logit(path) - logit(mean))))))
    return out


def test_site_posteriors_against_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(700):
        h = rng.choice(["a", "b", "c", "d", None])
        q = rng.choice(["x", "y", None])
        level = {"a": 0.8, "b": 0.3}.get(h, 0.5) + {"x": 0.15, "y": -0.2}.get(q, 0)
        rows.append((i, h, q, min(0.99, max(0.01, rng.gauss(level, 0.02)))))
    rows.append((700, "rare", "only", 0.9))
    want = brute_sites(rows)
    got = quality.site_scores(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r["host_posterior"], r["path_posterior"], r["score"]), want[r["doc_id"]], atol=1e-9)


def test_quality_of_pages_by_url(spark):
    """A real host and path: those of the page's address."""
    pages = common.table(spark, SF, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    host, path = F.lower(F.split_part("url", F.lit("/"), F.lit(3))), F.split_part("url", F.lit("/"), F.lit(4))
    got = quality.quality_scores(pages, labels, host, path).collect()
    assert len(got) == pages.count() and all(0 < r["score"] < 1 for r in got)


# chat


def test_reply_paths_against_brute_force(spark):
    rng = random.Random(2)
    nodes = [(i, rng.randrange(i) if i % 9 else (None if i % 2 else -5), float(rng.randint(0, 5))) for i in range(1, 80)]
    nodes.append((0, None, None))
    parent, score = {n: p for n, p, _ in nodes}, {n: s or 0.0 for n, _, s in nodes}
    leaves = set(parent) - set(parent.values())
    by_root = {}
    for leaf in leaves:
        path = [leaf]
        while parent[path[-1]] in parent:
            path.append(parent[path[-1]])
        by_root.setdefault(path[-1], []).append((-sum(score[x] for x in path), leaf, path))
    want = sorted((leaf, x, k) for root in by_root for _, leaf, path in sorted(by_root[root])[:2] for k, x in enumerate(path))
    got = chat.reply_paths(spark.createDataFrame(nodes, "node long, parent long, score double"), 2)
    assert sorted((r["path"], r["node"], r["up"]) for r in got.collect()) == want


def test_cycles_have_no_root(spark):
    nodes = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, None, 1.0), (4, 3, 1.0)], "node long, parent long, score double")
    assert sorted((r["path"], r["node"]) for r in chat.reply_paths(nodes).collect()) == [(4, 3), (4, 4)]


def test_chat_round_trip(spark):
    odd = ["\\", "\\b", "### User: x", "</turn>\n", "</turn>", "\\l/turn>", "a\n### ", "", None, "####  ", "🙂 é"]
    rows = [(1, i, ("user", "assistant", "system", "to:ol", None, "=x")[i % 6], t) for i, t in enumerate(odd)]
    rows += [(None, 0, "user", "alone"), (2, None, "user", "tie"), (2, None, "user", "tie"), (3, 1, "assistant", "x" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    back = {r["conv_id"]: r["turns"] for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [(r or "", t or "") for _, _, r, t in rows[: len(odd)]]
    assert [t["loss"] for t in back[1]] == [r == "assistant" for _, _, r, _ in rows[: len(odd)]]
    assert len(back[None]) == 1 and len(back[2]) == 2 and len(back[3][0]["text"]) == 100_000
    assert chat.format_conversations(table.limit(0)).count() == 0


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    held = [(got[d]["score"], y) for d, y in labels.items() if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert area(held) > 0.9
    hits = sum(s >= 0.5 and y for s, y in held)
    assert 2 * hits / max(1, sum(s >= 0.5 for s, _ in held) + sum(y for _, y in held)) > 0.7


def test_forward_pass_against_plain_python(monkeypatch):
    """Embeddings of word and stem are summed, filters run over words, and maxima make the logit; long texts whole."""
    rng = random.Random(3)
    model = toxicity.Model(toxicity.Settings(noise=1.0))
    model.bias = [np.full(toxicity.FILTERS, 0.1 * i, np.float32) for i in range(3)]
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(50)]
    texts = ["", "one", "two words", None, *(" ".join(rng.choices(vocab, k=rng.randint(1, 90))) for _ in range(12))]
    monkeypatch.setattr(toxicity, "PART", 24)  # so that texts of 25 words and more go by parts
    got = model.logits([toxicity.word_ids(t) for t in texts])
    for text, logit in zip(texts, got, strict=True):
        words = (text or "").encode().split()
        rows = [model.emb[zlib.crc32(w) & 0xFFFF] + model.emb[zlib.crc32(w[:6], 1) & 0xFFFF] for w in words] + [np.zeros(toxicity.DIM)] * 3
        out = 0.0
        for k, width in enumerate(toxicity.WIDTHS):
            best = np.max([sum(rows[i + j] @ model.conv[k][j] for j in range(width)) for i in range(len(words) + 1)], axis=0) + model.bias[k]
            out += np.maximum(best, 0) @ model.dense[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
        assert abs(out - logit) < 1e-3


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (11, 0, 1), (8, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = brute.documents(spark)
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == len(brute.ROWS)
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs.withColumns({"__text": F.lit(1), "score": F.lit(2)}), labels.limit(0)).count() == len(brute.ROWS)
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs.drop("lang"), none).count() == len(brute.ROWS)


# nearest neighbours


def exact_neighbours(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        cos = x @ x[list(ids).index(q)]
        order = [j for j in np.lexsort((ids, -np.round(cos, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_ann_recall_on_whole_table(spark, sf):
    bad = lambda v: v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v)
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, sf, "embeddings").collect() if not bad(r["embedding"])]
    queries = [i for i, _ in rows if i % 50 == 0]
    every = exact_neighbours(rows, queries, len(rows))
    got = {}
    for r in ann.op6_ann(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(queries)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == 5
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {w[0] for w in every[q][:5]})
        truth = dict(every[q])
        assert all(abs(truth[f[1]] - f[2]) < 1e-9 for f in found)
    assert hits >= 0.9 * 5 * len(queries)


def clustered(n=6000, centres=120, dim=48):
    rng = np.random.default_rng(9)
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dim))


def test_ann_compares_little_where_vectors_cluster(spark):
    x = clustered()
    plan, share = ann.fit(x[:4096], len(x))
    assert plan.probes and share < 0.2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact_neighbours(list(enumerate(x)), list(range(0, len(x), 50)))
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 5 * len(want)


def test_probes_come_in_order_of_success():
    x = ann.unit(clustered(5))
    plan = ann.Plan(6, 1, 0, 0.8)
    low, high = plan._edges(48, 0)
    shift = ann._projection(48, 6, 0)[1]
    for row, p in zip(plan.sequence(0, x, 200), plan.project(0, x)):
        every = {}
        for cells in np.ndindex(*(high - low + 1)):
            chance, code = 0.0, 0
            for h, c in enumerate(cells):
                left = -99 if c == 0 else (c + low[h]) * ann.WIDTH - shift[h]
                right = 99 if c == high[h] - low[h] else (c + low[h] + 1) * ann.WIDTH - shift[h]
                phi = lambda z: 0.5 * (1 + math.erf((z - 0.8 * p[h]) / 0.6 / 2**0.5))
                chance += math.log(max(1e-30, phi(right) - phi(left)))
                code = code * ann.BASE + c
            every[code] = chance
        best = sorted(every.values(), reverse=True)[:200]
        assert np.allclose([every[c] for c in row.tolist()], best, atol=1e-3)


def test_ann_recall_beside_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x[1000:2400] = x[1000]  # a hot vector, then groups of ten copies
    x[2400:3400] = np.repeat(x[2400:3400:10], 10, axis=0)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, 1000, 10)  # vectors without copies
    least = {q: np.sort(np.delete(x @ x[q], q))[-5] for q in asked}
    got = ann.neighbours(table, (F.col("vec_id") < 1000) & (F.col("vec_id") % 10 == 0)).collect()
    assert sum(r["score"] >= least[r["query_id"]] - 1e-9 for r in got) >= 0.9 * 5 * len(asked)


def test_ann_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))
    got = [tuple(r) for r in ann.neighbours(table, F.col("vec_id") % 50 == 0).collect()]
    assert [r[2] for r in sorted(got) if r[0] == 0] == [1, 2, 50]
    assert [r[2] for r in sorted(got) if r[0] == 50] == [0, 1, 2]
    assert ann.neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    again = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (0, [1.0, 0.0]), (4, [0.0, 1.0]), (7, [1.0, 0.0, 0.0]), (50, [1.0, 1.0, 0.0])]
    twice = ann.neighbours(spark.createDataFrame(again, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in twice) == Counter({(0, 1, 0): 3, (0, 2, 0): 3, (0, 3, 4): 3, (50, 1, 7): 1})  # each row of an id asks, and is found
    assert ann.neighbours(table.where("vec_id = 0"), F.lit(True)).count() == 0


# token files


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    docs = brute.documents(spark).unionByName(brute.documents(spark, [(20, "don't stop <|endoftext|> I'll  go\u00a0 \u2009now\r\n\r\n", "en", "x"), (21, "z" * 300_000, "en", "x")]))
    manifest = tokenfile.write_tokens(docs, path, f"file://{tmp_path}/t", seq_len=64)
    got = sorted((tuple(r) for r in tokenfile.read_tokens(manifest).collect()), key=lambda r: r[1])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert g == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    one = tokenfile.TokenFile(manifest.orderBy("part").first()["path"])
    ids, mask = one.sequence(0)
    assert len(ids) == 64 and tokenfile.unpacked(mask).shape == (64,)
    root = lambda x: root(x.base) if isinstance(x.base, np.ndarray) else x
    assert not root(ids).flags.owndata and not root(mask).flags.owndata  # both lie in the mapped file
    assert tokenfile.read_tokens(tokenfile.write_tokens(docs.limit(0), path, f"file://{tmp_path}/e")).count() == 0


def test_token_pieces_are_those_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = "ab Z'st reve  \n\t9 0.,-_é\u00b5ſÀ¿×\u2010\u2014\u3000ł\u0301"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["z" * 270_000, " word's \n" * 70_000, "\n " * 300_000 + "end", "a 'll 're'd 'S" * 30_000]  # over a chunk
    assert token_lists(path, texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def token_lists(path, texts):
    ids, counts = tokenfile.encode_texts(path, texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(p[-1] == tokenfile.END_ID for p in parts)
    return [p[:-1].tolist() for p in parts]


def test_pieces_are_forgotten_and_met_again(monkeypatch):
    import public_tokenizers

    from commitlake.llm import pieces

    monkeypatch.setattr(pieces, "MAX_PIECES", 50)
    monkeypatch.setattr(tokenfile, "CHUNK", 20)
    tokenfile._tokenizer.cache_clear()
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i * j % 61}" for j in range(9)) for i in range(60)]
    first = token_lists(path, texts)
    tokenfile._tokenizer.cache_clear()
    monkeypatch.undo()
    assert token_lists(path, texts) == first
    tokenfile._tokenizer.cache_clear()


# mixing


def test_targets_share_by_weight_and_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 300)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15 and abs(sum(got.values()) - 1315) < 1e-6
    assert abs(got["b"] / 2 - (1315 - 45) / 3) < 1e-6 or got[None] == 900


def test_mixing_of_documents(spark):
    docs = brute.documents(spark, extra=False).withColumn("n_chars", F.length("text").cast("long"))
    plan = mixing.take(docs.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.text_digest().alias("__d"))).collect()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    clash = ["size", "target", "rest", "taken", "epochs", "source_size", "__uid"]
    wide = mixing.mix_documents(docs.select("*", *[F.lit(7).alias(c) for c in clash]))
    assert wide.columns == [*docs.columns, *clash] and Counter(map(tuple, wide.select(docs.columns).collect())) == Counter(map(tuple, mixed.collect()))


def test_running_sums_of_small_groups_are_split(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], rng.getrandbits(60) * 8, rng.randint(0, 9)) for i in range(400)] + [(400, None, 5, 1)]
    df = spark.createDataFrame(rows, "i long, g string, h long, v long")
    got = {r["i"]: r["before"] for r in common.split_running(df, "g", ["h", "i"], "v", "before", rows=10).collect()}
    for g in ("a", "b", None):
        run = 0
        for i, _, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            assert got[i] == run
            run += v


# decontamination


def test_decontamination_of_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "!!"), (None, item), (5, "zeta eta theta iota kappa lambda mu nu"), (1, "again words")], "item_id long, text string")
    rows = [(0, f"x {item.upper()}! kappa lambda mu nu", "en", "a"), (1, "a short, ONE here short one", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (3, "alpha beta gamma", "en", "a"), (None, item, "en", "a"), (6, "again words", "en", "a")]
    got = decontam.contamination(brute.documents(spark, rows), bench).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got)
    assert found == Counter([(0, 14, 13, 2, True), (1, 6, 4, 1, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (3, 3, 0, 0, False), (None, 9, 9, 1, False), (6, 2, 2, 1, False)])
    assert decontam.contamination(brute.documents(spark, rows).limit(0), bench).count() == 0
    assert decontam.contamination(brute.documents(spark, rows), bench.limit(0)).count() == len(rows)
    clean = decontam.drop_contaminated(brute.documents(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 3]  # one occurring item is enough, short ones too


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red blue green")], "item_id long, text string")
    rows = [(0, "red x y blue z green", "en", "a"), (1, "red " + "x " * 40 + "blue green", "en", "a")]
    windows = decontam.benchmark_windows(bench)
    index = decontam.build_index(brute.documents(spark, rows), windows, slack=24)
    terms = decontam.ranked_windows(spark, index, windows)
    docs = index.where("term is null").select("uid", "doc_id")
    assert {r["doc_id"] for r in decontam.proximity_matches(index, terms).join(docs, "uid").collect()} == {0}


# suffix dedup


def test_repeats_against_brute_force(spark):
    rng = random.Random(7)
    passage = "".join(rng.choices("abcd ", k=400))
    rows = [*brute.ROWS]
    for i in range(40):
        own = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 500)))
        a = rng.randrange(300)
        rows.append((30 + i, own + passage[a : a + rng.randint(90, 150)] + own[:120], "en", "s"))
    rows += [(200 + i, passage, "en", "s") for i in range(30)] + [(300, passage + passage, "en", "s"), (300, "y" * 500, "en", "s")]
    got = suffix_dedup.op10_frame(brute.documents(spark, rows)).collect()
    assert ORDER(map(tuple, got)) == ORDER(brute.without_repeats([(r[0], r[1]) for r in rows]))


@pytest.mark.parametrize("hot, shared", [(3, 20_000), (1, 4)])
def test_repeats_of_crowded_anchors(spark, monkeypatch, hot, shared):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARED", shared)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcd ", k=130))
    own = lambda n: "".join(rng.choices("xyz", k=n))
    rows = [(i, own(60) + passage + own(60), "en", "s") for i in range(25)]
    rows += [(100 + i, own(40) + passage[:70] + own(9)[: i % 3] + passage[70:] + own(30), "en", "s") for i in range(20)]
    rows += [(None, own(50) + passage[10:120] + own(3), "en", "s") for _ in range(8)] + [(200, passage, "en", "s")] * 6
    got = suffix_dedup.op10_frame(brute.documents(spark, rows)).collect()
    assert ORDER(map(tuple, got)) == ORDER(brute.without_repeats([(r[0], r[1]) for r in rows]))


def test_repeats_of_many_rows_without_an_id(spark):
    """Texts of one id are told apart by far more than the 23 bits that once let some of them collide."""
    rng = random.Random(21)
    passage = "".join(rng.choices("abcd ", k=180))
    rows = [(None, "".join(rng.choices("abcdefgh", k=rng.randint(100, 300))) + (passage if i % 97 == 0 else ""), "en", "s") for i in range(3000)]
    got = suffix_dedup.op10_frame(brute.documents(spark, rows, extra=False)).collect()
    assert ORDER(map(tuple, got)) == ORDER(brute.without_repeats([(r[0], r[1]) for r in rows]))


def test_repeats_in_a_text_over_a_piece(spark, monkeypatch):
    rng = random.Random(22)
    passage = "".join(rng.choices("abcd ", k=150))
    text = "".join(rng.choices("abcdefgh", k=30_000)) + passage + "".join(rng.choices("abcdefgh", k=20_000)) + passage
    rows = [(1, text, "en", "s"), (2, passage, "en", "s"), (3, text[20_000:20_400], "en", "s")]
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    got = suffix_dedup.anchor_runs(text.encode())
    monkeypatch.undo()
    runs = lambda r: {(int(g), int(f) + i) for g, f, n in zip(*r, strict=True) for i in range(n)}
    assert runs(got) == runs(suffix_dedup.anchor_runs(text.encode()))  # pieces give each window the same anchor
    got = suffix_dedup.op10_frame(brute.documents(spark, rows)).collect()
    assert ORDER(map(tuple, got)) == ORDER(brute.without_repeats([(r[0], r[1]) for r in rows]))


def test_no_repeats_in_an_empty_table(spark):
    assert suffix_dedup.op10_frame(brute.documents(spark).limit(0)).count() == 0


def test_drop_contaminated_keeps_clean_rows_of_a_shared_id(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"a {item} b"), (1, "a clean text"), (None, f"{item} end"), (None, "another clean text"), (2, "third clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert ORDER(map(tuple, got.collect())) == ORDER([rows[1], rows[3], rows[4]])


def test_tokens_of_texts_with_an_added_token():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain text", "東京 <|endoftext|> x", *(t.content for t in tok.get_added_tokens_decoder().values())]
    assert token_lists(path, texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
