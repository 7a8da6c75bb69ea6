import re
from collections import Counter

import corpus_pipeline
from commitlake.llm import common
from tests.llm import brute
from tests.llm.test_operators import jaccard_groups

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return {r["doc_id"]: tuple(r) for r in df.collect()}


def passages(spark, sf_dir):
    out = set()
    for r in common.table(spark, sf_dir, "benchmark").collect():
        w = WORDS.findall((r["text"] or "").encode().lower())
        out |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))} if w else set()
    return out


def test_each_stage_on_its_own_input(spark):
    docs = common.table(spark, SF, "documents").cache()
    stage = {name.split()[0]: f for name, f in corpus_pipeline.STAGES}
    assert len(corpus_pipeline.STAGES) == 5
    first = stage["toxicity"](spark, docs, SF).cache()
    assert rows(first).items() <= rows(docs).items() and first.columns == docs.columns

    second = stage["simhash"](spark, first, SF).cache()
    texts = {d: r[first.columns.index("text")] for d, r in rows(first).items()}
    ids = sorted(texts)
    groups = jaccard_groups([texts[d] for d in ids])  # the stage's own rule: five words, a similarity of 0.8
    assert set(rows(second)) == {ids[k] for k in groups} and second.count() == len(rows(second))

    third = stage["benchmark"](spark, second, SF).cache()
    bad, sizes = passages(spark, SF), {len(p) for p in passages(spark, SF)}
    clean = set()
    for d, r in rows(second).items():
        w = WORDS.findall((r[second.columns.index("text")] or "").encode().lower())
        if not any(tuple(w[k : k + n]) in bad for n in sizes for k in range(len(w) - n + 1)):
            clean.add(d)
    assert set(rows(third)) == clean

    fourth = stage["mixing"](spark, third, SF).cache()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, took, times = Counter(), Counter(), Counter()
    for r in third.collect():
        have[r["source"]] += size(r["text"])
    whole = {r["doc_id"]: r["text"] or "" for r in third.collect()}
    for r in fourth.collect():
        took[r["source"]] += size(r["text"])
        times[r["doc_id"]] += 1
        assert whole[r["doc_id"]].startswith(r["text"] or "")
    assert max(times.values()) <= 3 and abs(sum(took.values()) - sum(have.values())) <= len(have)

    fifth = stage["sharding"](spark, fourth, SF)
    assert Counter(map(tuple, fifth.select(fourth.columns).collect())) == Counter(map(tuple, fourth.collect()))
    slots = {}
    for r in fifth.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(24)) <= 1


def test_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", brute.documents(spark)), ("empty", brute.documents(spark).limit(0))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == [*docs.columns, "shard", "slot"]
        assert (out.count() > 0) == (name == "odd")
