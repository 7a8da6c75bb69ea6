import json
import random

import pytest
from pyspark.sql import functions as F

from commitlake.engine import Engine
from commitlake.functions import richtext as rt
from commitlake.functions import scalars, stamps
from commitlake.operators import authz, change, graph, query, schema
from commitlake.sources import log
from commitlake.streaming import incremental

NOTE = schema.Scheme("note", 1, {"text": schema.FieldDef("string", required=True), "tags": schema.FieldDef("set"), "due": schema.FieldDef("date")})


def line(id, key, ts, parents=(), text="x", connection="A", **more):
    c = {"ver": 1, "id": id, "k": key, "s": "s1", "ts": ts, "org": "localhost", "c": {"r": {"s": "note/1", "d": {"text": text} | more, "n": True, "cs": text}}, "cid": connection}
    return json.dumps(c | ({"p": list(parents)} if parents else {}))


def test_log_is_repaired_deduplicated_and_aged(spark, tmp_path):
    rows = [line("r", "a", 1), "", line("x", "a", 2, ["r"]), line("r", "a", 1), line("y", "a", 3, ["r"], connection="B"), '{"id": "bro', line("z", "a", 9, ["y"])]
    (tmp_path / "one.jsonl").write_text("\n".join(rows))
    got = log.read_log(spark, str(tmp_path / "one.jsonl"))
    assert [(r["id"], r["age"]) for r in got.orderBy("age").collect()] == [("r", 1), ("x", 2), ("y", 3)]
    assert sorted(r["id"] for r in graph.leaves(got).collect()) == ["x", "y"]
    assert graph.heads(got).first()["id"] == "y" and graph.heads(got, connection="A").first()["id"] == "x"
    pairs = spark.createDataFrame([("x", "y"), ("r", "x")], "a string, b string")
    assert {(r["a"], r["lca"]) for r in graph.lca_pairs(got.drop("checksum"), pairs).collect()} == {("x", "r"), ("r", None)}


@pytest.mark.parametrize("shape, want", [
    ({"r": [], "a": ["r"], "b": ["r"], "m": ["a", "b"]}, {"merged": 1}),
    ({"r": [], "a": ["r"], "b": ["r"], "m1": ["a", "b"], "m2": ["a", "b"]}, {"base": "b"}),
    ({"r1": [], "r2": []}, {"unmerged": 1}),
])
def test_merge_bases(spark, shape, want):
    rows = [(i, "k", n, f"c{n}", p, None) for n, (i, p) in enumerate(shape.items())]
    c = spark.createDataFrame(rows, "id string, key string, ts int, connection string, parents array<string>, base string")
    got = graph.merge_bases(c).first()
    for k, v in want.items():
        assert (got[k] if k == "base" else len(got[k])) == v


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    repo = engine.repo("/data/notes")
    assert repo.count() == -1
    rows = spark.createDataFrame([("a", "lorem one", ["x", "w"]), ("b", "ipsum", None), ("c", "lorem two", [])], "key string, text string, tags array<string>").withColumn("due", F.timestamp_seconds(F.lit(1_700_000_000)))
    repo.create(rows, NOTE)
    assert repo.count() == 3
    q = repo.query(NOTE, lambda ctx: F.col("text").startswith(ctx["p"]), [F.desc("text")], {"p": "lorem"})
    assert [r["key"] for r in q.results().collect()] == ["c", "a"]
    first = repo.item("a", NOTE).first()
    assert first["tags"] == ["w", "x"] and first["due"].year == 2023
    changed = repo.set_value(rows.withColumn("text", F.when(F.col("key") == "b", "lorem three").otherwise(F.col("text"))), NOTE)
    assert [r["key"] for r in changed.collect()] == ["b"]
    assert repo.query(NOTE, lambda ctx: F.col("text").startswith("lorem"), []).count() == 3 and repo.commits.count() == 4
    with pytest.raises(ValueError):
        repo.create(rows.withColumn("other", F.lit(1)), NOTE)
    with pytest.raises(ValueError):
        engine.repo("one")


def delta(id, key, ts, base, changes, sc, dc, parents, connection="A"):
    body = {"b": base, "e": {"sc": sc, "dc": dc, "c": changes, "s": "note/1"}}
    return json.dumps({"ver": 1, "id": id, "k": key, "s": "s1", "ts": ts, "org": "localhost", "c": body, "p": parents, "cid": connection})


def test_items_of_deltas_corruption_and_unreadable_leaves(spark, tmp_path):
    from commitlake.operators import records

    one = schema.Scheme("note", 1, {"text": schema.FieldDef("string"), "tags": schema.FieldDef("set"), "due": schema.FieldDef("date"), "n": schema.FieldDef("number")})

    def sums(*payloads):
        df = spark.createDataFrame([(p,) for p in payloads], "p string").select(schema.raw_record(F.col("p"), one).alias("r"))
        return [r[0] for r in df.select(records.record_checksum("r", schema.kinds(one))).collect()]

    old = {"text": "old", "tags": {"__t": "S", "__v": ["a", "b"]}, "due": {"__t": "D", "__v": 1_700_000_000.5}, "n": 1.5}
    new = {"text": 'say "hi"', "tags": {"__t": "S", "__v": ["b", "c"]}, "due": {"__t": "D", "__v": 1_700_000_001}, "n": 1.5}
    a, b, gone = sums(json.dumps(old), json.dumps(new), json.dumps(old | {"isDeleted": True}))
    edit = {"text": [{"operation": 1, "value": 'say "hi"'}], "tags": [{"operation": -1, "value": {"__t": "S", "__v": ["a"]}}, {"operation": 1, "value": {"__t": "S", "__v": ["c"]}}], "due": [{"operation": 1, "value": {"__t": "D", "__v": 1_700_000_001}}]}
    more = {k: v for k, v in old.items() if k != "text"}
    rows = [
        line("f1", "good", 1, text="old", **more), delta("d1", "good", 2, "f1", edit, a, b, ["f1"]),
        line("f2", "bad", 1, text="old", **more), line("g2", "bad", 2, ["f2"], text="newer"), delta("d2", "bad", 3, "f2", edit, a, "wrong", ["g2"]),
        line("f3", "gone", 1, text="old", **more), delta("d3", "gone", 2, "f3", {"isDeleted": [{"operation": 1, "value": True}]}, a, gone, ["f3"]),
        line("f4", "far", 1, text="kept"), delta("d4", "far", 2, "absent", edit, a, b, ["f4"]),
        delta("d5", "never", 2, "absent", edit, a, b, []),
    ]
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "notes.jsonl").write_text("\n".join(rows))
    repo = Engine(spark, str(tmp_path)).repo("data/notes")
    got = {r["key"]: r for r in repo.items(one).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"good": 'say "hi"', "bad": "newer", "far": "kept"}
    assert got["good"]["id"] == "d1" and got["good"]["tags"] == ["b", "c"] and got["good"]["n"] == 1.5
    assert got["good"]["due"].timestamp() == 1_700_000_001 and got["far"]["id"] == "f4"
    assert [r["id"] for r in repo.commits_of("bad").collect()] == ["d2", "g2", "f2"] and repo.commit("d4").count() == 1


def test_writes_deltas_and_merges(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    repo = engine.repo("data/notes")
    rows = spark.createDataFrame([(f"k{i}", "long " * 30, ["x"], "2024-01-02 03:04:05") for i in range(12)], "key string, text string, tags array<string>, d string").select("key", "text", "tags", F.to_timestamp("d").alias("due"))
    repo.create(rows, NOTE)
    query = repo.query(NOTE)
    assert query.count() == 12 and repo.query(NOTE) is query
    changed = repo.set_value(rows.withColumn("tags", F.array(F.lit("x"), F.lit("y"))), NOTE)
    assert changed.where("base is not null").count() >= 6  # one in twenty is full
    assert {tuple(r["tags"]) for r in repo.query(NOTE).results().collect()} == {("x", "y")} and repo.items(NOTE).first()["text"] == "long " * 30
    assert repo.set_value(repo.items(NOTE).select("key", "text", "tags", "due"), NOTE).count() == 0
    # two sides go on from the same head
    head = repo.heads().where("key = 'k1'").first()["id"]
    mark = lambda tags, text: {"text": text, "tags": {"__t": "S", "__v": tags}}
    import os

    sides = [("m1", "A", 4_000_000_000_000, mark(["x", "y", "z"], "long " * 30)), ("m2", "B", 4_000_000_000_001, mark(["y"], "other"))]
    with open(os.path.join(str(tmp_path), "data", "notes.jsonl", "more.txt"), "w") as f:
        f.write("\n".join(json.dumps({"ver": 1, "id": i, "k": "k1", "s": "s", "ts": ts, "org": "localhost", "p": [head], "cid": c, "c": {"r": {"s": "note/1", "d": d, "cs": i}}}) for i, c, ts, d in sides))
    repo.forget()
    made = repo.merge(NOTE)
    assert [(r["key"], sorted(r["parents"]), r["merge_base"]) for r in made.collect()] == [("k1", ["m1", "m2"], head)]
    now = {r["key"]: r for r in repo.query(NOTE).results().collect()}["k1"]
    assert now["tags"] == ["y", "z"] and now["text"] == "other" and repo.merge(NOTE).count() == 0


def test_heads_by_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, ids = [], {}
    for i in range(60):
        key = f"k{rng.randrange(5)}"
        old = ids.setdefault(key, [])
        rows.append(line(f"c{i:03}", key, i, [rng.choice(old)] if old else []))
        old.append(f"c{i:03}")
    src = tmp_path / "in"
    src.mkdir()
    state = incremental.HeadTable(spark, f"file://{tmp_path}/heads")
    shuffled = rng.sample(rows, len(rows))
    for n in range(3):
        (src / f"p{n}.jsonl").write_text("\n".join(shuffled[n * 20 : n * 20 + 25]))
        incremental.maintain_heads(incremental.read_commits(spark, str(src)), state.path, f"file://{tmp_path}/cp").awaitTermination()
    (tmp_path / "all.jsonl").write_text("\n".join(rows))
    whole = log.read_log(spark, str(tmp_path / "all.jsonl"))
    want = {(r["key"], r["id"]) for r in graph.newest_per(graph.leaves_raw(whole), "key").collect()}
    assert {(r["key"], r["id"]) for r in state.heads().collect()} == want


def test_streaming_state_is_bounded(spark, tmp_path):
    """Twenty batches of a chain for each key, parents late and commits repeated: the state is that of a week."""
    state = incremental.HeadTable(spark, f"file://{tmp_path}/heads", keep="7 days")
    shape = "id string, key string, ts timestamp, parents array<string>, connection string"
    day = lambda i: F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * i))
    sizes = []
    for i in range(20):
        late = [(f"{k}-{i}", k, [f"{k}-{i - 1}"] if i else [], "A") for k in ("a", "b")]
        order = late if i % 2 else [(f"{k}-{i}", k, p, c) for _, k, p, c in late]
        again = [(f"{k}-{i - 1}", k, [f"{k}-{i - 2}"] if i > 1 else [], "A") for k in ("a",)] if i else []
        rows = spark.createDataFrame([*order, *again], "id string, key string, parents array<string>, connection string")
        batch = rows.withColumn("ts", F.when(F.col("id").endswith(f"-{i}"), day(i)).otherwise(day(i - 1))).select([c.split()[0] for c in shape.split(", ")])
        state.update(batch, i)
        sizes.append(state.state().count())
        assert {(r["key"], r["id"]) for r in state.heads().collect()} == {(k, f"{k}-{i}") for k in ("a", "b")}
    assert max(sizes) <= 2 * 9 and sizes[-1] == sizes[-2] and len(state.complete()) == 2


def test_parents_may_come_after_their_children(spark, tmp_path):
    state = incremental.HeadTable(spark, f"file://{tmp_path}/heads")
    ts = F.timestamp_seconds(F.lit(1_700_000_000))
    for n, rows in enumerate([[("c", "k", ["b"])], [("b", "k", ["a"])], [("a", "k", [])], [("d", "k", ["c"])]]):
        batch = spark.createDataFrame(rows, "id string, key string, parents array<string>").withColumns({"ts": ts, "connection": F.lit("A")})
        state.update(batch, n)
        state.update(batch, n)  # a batch that is repeated
        assert [r["id"] for r in state.heads().collect()] == ["d" if n == 3 else "c"]


def test_results_are_kept_up_to_date_by_stream(spark, tmp_path):
    rng = random.Random(5)
    heads, found = {}, incremental.ResultTable(spark, f"file://{tmp_path}/r", predicate=lambda ctx: F.col("value") > ctx["least"], ctx={"least": 5})
    before = set()
    for n in range(4):
        touched = {rng.randrange(12): rng.randrange(10) for _ in range(6)}
        heads |= touched
        df = spark.createDataFrame(list(heads.items()), "key long, value long")
        delta = {(r["key"], r["change"]) for r in found.update(df, df.where(F.col("key").isin(list(touched))), n).collect()}
        now = {k for k, v in heads.items() if v > 5}
        assert {r["key"] for r in found.state().collect()} == now
        assert delta == {(k, "added") for k in now - before} | {(k, "removed") for k in before - now}
        before = now


def test_query_cache_python_and_comparator(spark, tmp_path):
    items = spark.createDataFrame([(i, i * 7 % 10, i + 1) for i in range(20)], "key long, value long, age long")
    q = query.Query(items, predicate=F.col("value") > 4, name="n")
    q.save(str(tmp_path / "cache"), 20)
    assert {r["key"] for r in q.load(spark, str(tmp_path / "cache")).collect()} == {r["key"] for r in q.keys().collect()}
    assert query.Query(items, predicate=F.col("value") > 5, name="n").id != q.id
    assert query.where_python(items, lambda r: r["value"] % 2 == 0).count() == 10
    assert query.sorted_by(items, lambda a, b: b["key"] - a["key"])["key"].tolist() == list(range(19, -1, -1))
    with pytest.raises(ValueError):
        query.sorted_by(items, lambda a, b: 0, max_rows=5)


def test_set_and_map_patches(spark):
    kinds = {"s": ("set", "array<string>"), "m": ("map", "map<string,string>"), "x": ("number", "double")}
    rows = [((["a", "b"], {"k": "1", "j": "2"}, 1.0), (["b", "c"], {"k": "9"}, None)), ((None, None, None), (["a"], {"z": "1"}, 2.0)), ((["a"], {"a": "1"}, 2.0), (None, None, 2.0))]
    t = "struct<s:array<string>,m:map<string,string>,x:double>"
    df = spark.createDataFrame(rows, f"a {t}, b {t}").withColumn("d", change.diff({n: k for n, (k, _) in kinds.items()}, "a", "b"))
    for r in df.select("b", change.patch(kinds, "a", "d").alias("r")).collect():
        assert r["r"] == r["b"]


def test_schemes(spark):
    reg = schema.SchemeRegistry()
    reg.register(NOTE)
    reg.register(schema.Scheme("note", 3, {}))
    assert reg.get("note").version == 3 and reg.versions("note") == [3, 1]
    with pytest.raises(ValueError):
        reg.path("note", 1, 3)
    with pytest.raises(ValueError):
        schema.FieldDef("float")
    df = spark.createDataFrame([('{"text": "x", "odd": 1}', None)], "payload string, text string").withColumns({"tags": F.array().cast("array<string>"), "due": F.lit(None).cast("timestamp"), "isDeleted": F.lit(False)})
    assert df.select(schema.violations(df, NOTE, "payload").alias("v")).first()["v"] == ["missing:text", "unknown:odd"]


def test_directory_rules(spark):
    users = spark.createDataFrame([("op", "op@x.org", []), ("u", "u@x.org", []), ("m", "m@x.org", ["manage:users"])], "user string, email string, permissions array<string>")
    asked = [
        ("op", "w", "workspaces", True, [], False, True, [], True), ("u", "w", "workspaces", True, ["u"], False, True, [], True),
        ("u", "w", "workspaces", True, ["z"], False, False, [], False), ("u", "w", "workspaces", False, None, False, True, [], True),
        ("u", "u", "users", True, None, False, True, ["name"], True), ("u", "u", "users", True, None, False, True, ["email"], False),
        ("u", "m", "users", True, None, False, False, [], True), ("u", "m", "users", True, None, False, True, ["name"], False),
        ("m", "u", "users", True, None, False, True, ["email"], True), (None, "s", "sessions", True, None, True, False, [], True),
        (None, "s", "sessions", True, None, False, False, [], False), ("u", "s", "sessions", True, None, False, True, [], False), ("root", "x", "odd", True, None, False, True, [], True),
    ]
    df = spark.createDataFrame(asked, "user string, key string, namespace string, exists boolean, members array<string>, own_session boolean, write boolean, changed array<string>, want boolean")
    for r in authz.directory_allows(df, users, ["op@x.org"]).collect():
        assert r["allowed"] == r["want"], r


def test_trust(spark):
    s = spark.createDataFrame([("a", 5, None), ("a", 9, "u"), ("a", 9, None), ("b", 1, "root")], "session string, expiration int, owner string")
    got = {(r["session"], r["expiration"], r["owner"]) for r in authz.trusted_sessions(s).collect()}
    assert got == {("a", 9, "u"), ("b", 1, "root")}
    c = spark.createDataFrame([("a", 9), ("b", 2), ("z", 0)], "session string, ts int")
    assert [r["session"] for r in authz.signed_in_time(c, s).collect()] == ["a"]


def test_strings(spark):
    one = spark.range(1).select(scalars.writing_direction(F.lit("12 שלום")).alias("d"), scalars.is_rtl(F.lit("שלום")).alias("r"), scalars.normalize_email(F.lit(" A.b@Mail.co ")).alias("e"), scalars.normalize_email(F.lit("no")).alias("n"), scalars.match_ends(F.lit("a1b22c"), r"\d+").alias("m"), scalars.org_from_url(F.lit("https://Acme.example.com/x")).alias("o"), scalars.relative_label(F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")).alias("l")).first()
    assert tuple(one) == ("rtl", True, "a.b@mail.co", None, [2, 5], "acme", "Yesterday")


def test_order_stamps(spark):
    rng = random.Random(1)
    known = ["0" * 16, "f" * 16]
    for _ in range(300):
        i = rng.randrange(len(known) - 1)
        mid = stamps.midpoint(known[i + 1], known[i])
        assert known[i] < mid < known[i + 1]
        known.insert(i + 1, mid)
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "x string, y string").select(stamps.between("x", "y").alias("m"))
    assert [r["m"] is None for r in df.collect()] == [False, True]


TREE = {"children": [{"tagName": "h1", "children": [{"text": "Title"}]}, {"tagName": "p", "children": [{"text": "some "}, {"text": "bold", "bold": True}, {"ref": "t1"}]}, {"tagName": "ul", "children": [{"tagName": "li", "children": [{"text": "one"}]}]}]}


def test_rich_text_reading(spark):
    assert rt.plain_text(TREE) == "Title\nsome bold\n\none"
    assert rt.markdown(TREE) == "\n# \nTitle\n\nsome bold\n\n* \none"
    assert rt.refs(TREE) == ["t1"] and rt.direction(TREE) == "ltr" and len(rt.node_keys(TREE)) == len(set(rt.node_keys(TREE)))
    assert rt.rebuild(rt.flatten(TREE)) == TREE
    df = spark.createDataFrame([(json.dumps(TREE),), (None,)], "body string")
    assert [r[0] for r in df.select(rt.plain_text_of("body")).collect()] == ["Title\nsome bold\n\none", None]
    assert df.select(F.size(rt.atoms_of("body")).alias("n")).first()["n"] == len(rt.flatten(TREE))
    composed = rt.compose(TREE, {"t1": rt.from_plain("task")})
    assert "task" in rt.plain_text(composed) and rt.decompose(composed) == (TREE, {"t1": rt.from_plain("task")})
    assert rt.refs(rt.compose(TREE, {"t1": None})) == []


def test_rich_text_diff_and_merge(spark):
    rng = random.Random(6)

    def edited(tree):
        atoms = rt.flatten(tree)
        for _ in range(3):
            at = rng.randrange(len(atoms) + 1)
            atoms[at:at] = [("char", "{}", c) for c in rng.choice(["new", "word ", "!"])]
        chars = [i for i, a in enumerate(atoms) if a[0] == "char"]
        del atoms[rng.choice(chars)]
        return rt.rebuild(atoms)

    for _ in range(40):
        a, b = edited(TREE), edited(TREE)
        assert rt.patch(TREE, rt.diff(TREE, a)) == a and rt.merge(TREE, [a]) == a and rt.merge(TREE, [a, a]) == a
        merged = rt.plain_text(rt.merge(TREE, [a, b]))
        assert all(merged.count(c) >= max(rt.plain_text(a).count(c), rt.plain_text(b).count(c)) - 1 for c in "!w")
    leaves = spark.createDataFrame([("k", "1", 1, json.dumps(TREE), json.dumps(edited(TREE))), ("k", "2", 2, json.dumps(TREE), json.dumps(TREE))], "key string, id string, ts int, base string, body string")
    assert rt.merge_rich_text(leaves).count() == 1
    got = rt.compose_items(spark.createDataFrame([("k", json.dumps(TREE))], "key string, body string"), spark.createDataFrame([("t1", json.dumps(rt.from_plain("task")), False)], "ref string, body string, deleted boolean")).first()
    assert "task" in rt.plain_text(json.loads(got["body"]))


def test_rich_text_normal_form():
    loose = {"children": [{"text": "a"}, {"text": "b"}, {"tagName": "ul", "children": [{"text": "x"}, {"tagName": "p", "children": [{"text": "y"}]}]}, {"tagName": "td", "children": [{"text": "z"}]}, {"tagName": "p", "children": [{"tagName": "p", "children": [{"text": "q"}]}]}]}
    now = rt.normalise(loose)
    assert rt.normalise(now) == now
    assert [n["tagName"] for n in now["children"]][:3] == ["p", "ul", "table"]
    assert [n["tagName"] for n in now["children"][1]["children"]] == ["li", "li"]
    assert all("tagName" in n for n in now["children"]) and "".join(rt.plain_text(now).split()) == "abxyzq"
    assert rt.normalise({"children": []}) == {"children": [{"tagName": "p", "children": [{"text": ""}]}]}
    assert rt.plain_text(rt.strip_formatting(TREE)) == "Titlesome boldone"
    assert [p["key"] for p in rt.live_pointers([{"key": "b", "type": "anchor", "expiration": 5}, {"key": "a", "type": "focus"}, {"key": "c", "type": "focus", "expiration": 1}], 3)] == ["a", "b"]


def test_deltas_and_good_ancestors(spark):
    from commitlake.operators import records, stats, sync

    kinds = {"x": ("string", "string"), "y": ("string", "string")}
    long = "z" * 100
    rows = [("f", None, True, ("a", long), 1), ("d", "f", False, ("b", long), 2), ("e", "f", False, ("b", "c" * 99), 3)]
    df = spark.createDataFrame(rows, "id string, base string, is_full boolean, record struct<x:string,y:string>, age long")
    got = {r["id"]: r for r in records.deltas(df, kinds).collect()}
    assert got["f"]["kept"] is False and got["d"]["delta_length"] < got["d"]["full_length"] < got["e"]["delta_length"] and got["e"]["kept"] is False
    graph_rows = [("r", [], False), ("a", ["r"], True), ("b", ["a"], True), ("c", ["b", "r"], True)]
    chain = spark.createDataFrame(graph_rows, "id string, parents array<string>, corrupt boolean")
    assert {(r["id"], r["good"]) for r in records.newest_good_ancestor(chain).collect()} == {("a", "r"), ("b", "r"), ("c", "r")}
    assert [sync.sync_rounds(d, 1000) for d in (100, 2500, 9000)] == [1, 2, 3] and abs(sync.sync_fpr(1000, 1, 3) - 0.01) < 1e-12
    m = spark.createDataFrame([("n", 1.0, 1), ("n", 3.0, 2)], "name string, v double, t int")
    assert [r["value"] for r in stats.exposition(stats.metric_rollup(m, ["name"], "v", "t"), "name").collect()] == ["n_count 2", "n_sum 4.0"]


def test_bloom_filter_bounds(spark):
    from commitlake.operators import sync

    ids = spark.range(11_000).withColumn("v", F.concat(F.lit("element-"), F.col("id").cast("string")))
    known = ids.where("id < 1000")
    f = sync.build(known, "v", 1000, 0.01)
    assert sync.may_contain(known, "v", f).count() == 1000
    assert sync.may_contain(ids.where("id >= 1000"), "v", f).count() <= 0.02 * 10_000
    assert 0.3 < sync.fill_rate(f) < 0.7 and sync.encode(f).agg(F.sum(F.bitmap_count("bitmap"))).first()[0] == f.bits.count()
    again = sync.decode(sync.encode(f), f.m, f.k, f.seed)
    assert again.bits.count() == f.bits.count() and again.bits.join(f.bits, "bit", "left_anti").isEmpty()


def test_ancestors_of_a_long_history(spark):
    rows = [(str(i), "k", i, [str(i - 1)] if i else [], None) for i in range(1300)] + [("x", "k", 2000, ["0"], None)]
    log = spark.createDataFrame(rows, "id string, key string, ts long, parents array<string>, base string")
    start = spark.createDataFrame([("1299",)], "id string")
    got = graph.ancestors(log, start, span=128).collect()
    assert sorted((r["depth"], r["anc"]) for r in got) == [(d, str(1299 - d)) for d in range(1, 1300)]
    pairs = spark.createDataFrame([("1299", "x")], "a string, b string")
    assert [tuple(r) for r in graph.lca_pairs(log, pairs, span=128).collect()] == [("1299", "x", "0")]


def test_mutation_packs(spark):
    from commitlake.operators import mutations as m

    pack = lambda *rows: F.array(*[m.mutation(f, F.lit(loc), F.lit(old)) for f, loc, old in rows])
    a, b = pack(("x", True, "1"), ("y", True, "2")), pack(("x", False, "9"), ("z", True, None))
    one = spark.range(1).select(m.append(a, b).alias("ab"), m.append(F.lit(None).cast(m.PACK), b).alias("b"), F.lit(None).cast(m.PACK).alias("none"))
    got = one.select("ab", m.length("none").alias("n0"), m.has_remote("ab").alias("r"), m.has_remote("b").alias("rb"), m.has_only_local("none").alias("l"), m.without_first("b").alias("w"), m.at("b", 5).alias("a5"), m.subtract_fields("ab", "b").alias("s"), m.has_field("ab", "q", "z").alias("f")).first()
    assert [tuple(x) for x in got["ab"]] == [("x", True, "1"), ("y", True, "2"), ("z", True, None)]
    assert (got["n0"], got["r"], got["rb"], got["l"], got["a5"], got["f"]) == (0, False, True, True, None, True)
    assert [x["field"] for x in got["w"]] == ["z"] and [x["field"] for x in got["s"]] == ["y"]


def test_what_a_repository_takes_in(spark, tmp_path):
    rows = [("a", "o", "note", None, "s"), ("a", "o", "note", None, "s"), ("b", "other", "note", None, "s"), ("c", None, None, None, "s"), ("d", None, None, "a", "s"), ("e", None, "task", None, "s"), ("f", None, "note", None, "x"), ("g", None, "note", None, "s")]
    commits = spark.createDataFrame(rows, "id string, org string, scheme_ns string, base string, session string")
    trusted, known = spark.createDataFrame([("s",)], "session string"), commits.where("id = 'g'")
    got = log.accepted(commits, known, "o", ["note"], trusted)
    assert sorted(r["id"] for r in got.collect()) == ["a", "d"]
    engine = Engine(spark, str(tmp_path))
    for name, key in (("one", "k"), ("two", "k"), ("three", "other")):
        engine.repo(f"data/{name}").create(spark.createDataFrame([(key, "t")], "key string, text string"), NOTE)
    assert sorted(r["repo"] for r in engine.holding("k").collect()) == ["data/one", "data/two"]


def test_base32_round_trip(spark):
    import base64

    words = ["", "a", "ab", "abc", "abcd", "abcde", "Zażółć gęślą", "x" * 33]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalars.encode_base32("w").alias("c"), scalars.decode_base32(scalars.encode_base32("w")).cast("string").alias("b"))
    for r in df.collect():
        assert r["c"] == base64.b32encode(r["w"].encode()).decode().replace("=", "_", 1).lower() and r["b"] == r["w"]


def test_quantiles_are_exact(spark):
    from commitlake.operators import stats

    n = 60_000
    ids = spark.range(n).select((F.col("id") % 2).cast("string").alias("name"), ((F.col("id") * 7919) % n).cast("double").alias("v"), F.col("id").alias("t"))
    odd = spark.createDataFrame([(None, 5.0, 1), (None, None, 2), ("none", None, 3)], "name string, v double, t long")
    got = {r["name"]: r["quantiles"] for r in stats.metric_rollup(ids.unionByName(odd), ["name"], "v", "t").collect()}
    for name in ("0", "1"):
        values = sorted(r["v"] for r in ids.where(F.col("name") == name).collect())
        assert got[name] == [next(v for i, v in enumerate(values) if (i + 1) / len(values) >= p) for p in stats.QUANTILES]
    assert got[None] == [5.0] * 3 and got["none"] is None


def test_rich_text_of_many_keys_needs_no_frame_for_each(spark):
    from commitlake.sources import runs

    tree = lambda t: json.dumps(rt.from_plain(t))
    rows = [(k if k < 2500 else None, n, n if n else None, tree("ab"), body) for k in range(2501) for n, body in ((2, tree("abc")), (1, tree("b")), (0, tree(f"{k}ab")), (3, None))]
    leaves = spark.createDataFrame(rows, "key long, id long, ts long, base string, body string")
    merged = rt.merge_rich_text(leaves)
    assert {r["key"]: rt.plain_text(json.loads(r["body"])) for r in merged.collect()} == {(k if k < 2500 else None): f"{k}bc" for k in range(2501)}
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()  # it costs some ten milliseconds a key
    import pyarrow as pa

    batch = lambda *keys: pa.record_batch({"key": pa.array(keys, "float64")})
    found = list(runs.runs([batch(None, None, 1), batch(1, 1), batch(1, float("nan")), batch(float("nan"))], limit=3))
    assert [(str(k), c and len(c[0])) for k, c in found] == [("None", 2), ("1.0", None), ("nan", 2)]


def test_bloom_filters_meet_packed(spark):
    import numpy as np

    from commitlake.operators import sync

    offsets = np.unique(np.random.default_rng(1).integers(0, 1 << 16, 5000))
    for x in (offsets, np.array([0]), np.array([(1 << 16) - 1])):
        assert (sync._decoded(sync._encoded(x)) == x).all()
    ids = spark.range(0, 30_000, 1, 3)
    f = sync.build(ids, "id", 30_000, 1e-4, 5)
    want = {r["bit"] for r in ids.select(F.explode(sync.positions(F.col("id"), f.m, f.k, 5)).alias("bit")).collect()}
    got = [r["bit"] for r in f.bits.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan(f.packed)  # no row for each bit
    others = spark.createDataFrame([(7,), (40_000,), (40_000,), (None,)], "id long")
    assert [r["id"] for r in sync.absent(others, "id", f).collect()] == [40_000] * 2
    assert sync.absent(ids, "id", f).isEmpty()


def odd_log(spark):
    """Histories with forks, merges, missing parents, unreadable commits and, in the last key, a parent of another."""
    rng, rows = random.Random(5), []
    for key in "abcd":
        ids = [f"{key}{n:02}" for n in range(25)]
        for n, i in enumerate(ids):
            parents = sorted({ids[rng.randrange(max(0, n - 4), n)] for _ in range(rng.choice([1, 1, 2]))}) if n else []
            parents += ["gone"] if n == 7 else ["a03"] if key == "d" and n == 5 else []
            rows.append((i, key if key != "c" else None, n // 2, f"c{n % 5}", parents, ids[2] if n % 3 else "lost" if n % 9 == 3 else None, n % 4 == 1))
    return spark.createDataFrame(rows, "id string, key string, ts int, connection string, parents array<string>, base string, corrupt boolean")


@pytest.mark.parametrize("limit, keys", [(1000, "abc"), (1000, "abcd"), (20, "abd")])
def test_walks_within_keys_and_by_joins_agree(spark, monkeypatch, limit, keys):
    from commitlake.operators import histories

    monkeypatch.setattr(histories, "LIMIT", limit)
    log = odd_log(spark).where(F.substring("id", 1, 1).isin(list(keys))).localCheckpoint()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(graph.ancestors(log)) == rows(graph._ancestors_by_levels(log))
    assert rows(graph.forest(log)) == rows(graph._forest_by_levels(log))
    one = log.select(F.substring("id", 1, 1).alias("k"), "id")
    pairs = one.where("substring(id, 2) >= '18'").alias("x").join(one.where("substring(id, 2) < '25'").alias("y"), "k").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).where("a <> b")
    pairs = pairs.unionByName(spark.createDataFrame([("a20", "b20"), ("a20", "none"), ("none", "a20")], "a string, b string")).where("hash(a, b) % 3 = 0 or b = 'none'").localCheckpoint()
    assert rows(graph.lca_pairs(log, pairs)) == rows(graph._lca_by_levels(log.withColumn("key", F.coalesce("key", F.lit("c"))), pairs))  # joins don't meet null keys
    tips = log.where("substring(id, 2) > '19'")
    if limit > 20 and "d" not in keys:
        assert rows(graph.merge_bases(log, tips).select("key", "base", "merged", "unmerged")) == rows(graph._merge_bases_by_turns(log.withColumn("key", F.coalesce("key", F.lit("c"))), tips.withColumn("key", F.coalesce("key", F.lit("c")))).select(F.nullif("key", F.lit("c")).alias("key"), "base", "merged", "unmerged"))


def test_a_short_history_takes_no_rounds_of_joins(spark, monkeypatch):
    def never(*args, **more):
        raise AssertionError("expanded by joins")

    for name in ("_ancestors_by_levels", "_lca_by_levels", "_merge_bases_by_turns", "_forest_by_levels"):
        monkeypatch.setattr(graph, name, never)
    log = odd_log(spark).where("id < 'd'")
    pairs = spark.createDataFrame([("a20", "a22")], "a string, b string")
    assert graph.ancestors(log, pairs.select(F.col("a").alias("id"))).count() and graph.forest(log).count() and graph.lca_pairs(log, pairs).count() == 1 and graph.merge_bases(log).count() == 3


def test_good_ancestors_within_keys(spark, monkeypatch):
    from commitlake.operators import records

    log = odd_log(spark)
    want = {tuple(r) for r in records._good_by_levels(log.where("id < 'd'")).collect()}
    whole = {tuple(r) for r in records._good_by_levels(log).collect()}
    assert {tuple(r) for r in records.newest_good_ancestor(log).collect()} == whole  # with a parent of another key
    monkeypatch.setattr(records, "_good_by_levels", None)
    assert {tuple(r) for r in records.newest_good_ancestor(log.where("id < 'd'")).collect()} == want and want
