"""Texts beyond the pieces that operators work by, and whole queries over odd and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlake.llm import common, decontam, mixing, quality, queries, sharding, simhash
from tests.llm import brute

LABELS = "doc_id long, quality int, toxic int"


def test_fingerprint_of_a_text_over_a_piece():
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=70_000))
    assert int(simhash.fingerprints([simhash.text_hashes(text.encode())])[0]) == brute.fingerprint(text)


def test_a_passage_at_the_end_of_a_long_text(spark):
    rng = random.Random(5)
    filler = " ".join(rng.choices([f"w{i}" for i in range(900)], k=120_000))
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, f"{filler} {item}"), (2, filler)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (120_009, 9, 1) and got[2]["n_hit"] == 0


def test_long_texts_are_weighed_and_scored_whole(spark):
    words = 150_000
    rows = [(1, "word " * words, "en", "a"), (2, None, "en", "a"), (3, "x", "en", None)]
    docs = brute.documents(spark, rows)
    sizes = {r["doc_id"]: r["n"] for r in docs.select("doc_id", mixing.word_count("text").alias("n")).collect()}
    assert sizes == {1: words, 2: 0, 3: 1}
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0)], LABELS)
    got = quality.quality_scores(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 3 and all(0 < r["score"] < 1 for r in got)
    assert len(quality.shape_of(rows[0][1])[0]) == 9 and np.isfinite(quality.shape_of(rows[0][1])[0]).all()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Folders of whole tables: odd rows, and none."""
    out = {}
    for name in ("odd", "empty"):
        at = f"{tmp_path_factory.mktemp(name)}"
        keep = (lambda df: df) if name == "odd" else (lambda df: df.limit(0))
        keep(brute.documents(spark)).write.parquet(f"{at}/documents.parquet")
        keep(spark.createDataFrame([(0, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], LABELS)).write.parquet(f"{at}/labels.parquet")
        keep(spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
        keep(spark.createDataFrame([(0, [1.0, 0.5]), (50, [1.0, 0.0]), (1, None), (None, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")).write.parquet(f"{at}/embeddings.parquet")
        keep(spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 3, None, "x")], "conv_id long, turn long, role string, text string")).write.parquet(f"{at}/conversations.parquet")
        out[name] = at
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_of_odd_and_empty_tables(spark, odd, name):
    got = queries.QUERIES[name](spark, odd["odd"]).collect()
    none = queries.QUERIES[name](spark, odd["empty"])
    if name == "op4_chat":
        assert sorted((r["conv_id"] is None, r["conv_id"] or 0, r["n_turns"]) for r in got) == [(False, -7, 2), (False, 1, 2), (True, 0, 1)]
        assert [r["conv_id"] for r in none.collect()] == [-7]
        return
    assert none.count() == 0
    if name == "op6_ann":  # three vectors are asked; both of id 50 see each other
        assert Counter(r["query_id"] for r in got) == {0: 2, 50: 4} and sum(r["vec_id"] == 50 for r in got if r["query_id"] == 50) == 2
        return
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in brute.ROWS)
    if name == "op1_sharding":
        want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in brute.ROWS)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        assert all(r["slot"] == 0 and r["law"] == "rows" and r["grown_shard"] is None for r in got) and len({r["shard"] for r in got}) == len(got)


def test_shards_are_uniform(spark):
    """Where a row lands does not depend on its place: each shard holds about its share of the first rows."""
    rows = common.durable(spark.range(4000).withColumnRenamed("id", "__uid"), "t")
    got = Counter(r["shard"] for r in sharding.deal(rows, 4, partitions=8).where("__uid < 2000").collect())
    assert sum(got.values()) == 2000 and all(420 < got[s] < 580 for s in range(4))
