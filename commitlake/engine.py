"""Entry points: an engine over a folder of commit logs, and repositories with items, keys, queries and writes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators import change, graph, merge, records
from .operators.query import Query
from .operators.schema import Scheme, kinds, raw_record, typed_record
from .sources import log
from .sources.tables import written


class Engine:
    """``path/<type>/<id>.jsonl`` (files or folders of files) are the repositories."""

    def __init__(self, spark: SparkSession, path: str, org: str = "localhost"):
        self.spark, self.path, self.org = spark, path.rstrip("/"), org
        self._open: dict[str, Repo] = {}
        self._queries: dict[str, tuple[str, Query]] = {}

    def repo(self, path: str) -> Repo:
        name = path.strip("/")
        if len(name.split("/")) != 2:
            raise ValueError("a repository path has two components")
        return self._open.setdefault(name, Repo(self, name))

    def query(self, source: DataFrame | Query, **config) -> Query:
        """Open queries by id; those of a repository are forgotten when it is written to."""
        q = Query(source, **config)
        return self._queries.setdefault(q.id, (q.name, q))[1]

    def holding(self, key: str) -> DataFrame:
        """(repo): the repositories with a commit of a key, in one scan of all logs."""
        lines = self.spark.read.text(f"{self.path}/*/*.jsonl").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("j"))
        name = F.regexp_extract("file", r"([^/]+/[^/]+)\.jsonl(/|$)", 1)
        return lines.where(F.try_variant_get("j", "$.k", "string") == key).select(name.alias("repo")).distinct()

    def forget(self, name: str) -> None:
        self._queries = {i: (n, q) for i, (n, q) in self._queries.items() if n != name}

    def close(self, path: str) -> None:
        found = self._open.pop(path.strip("/"), None)
        if found is not None:
            found.forget()


class Repo:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name
        self.path = f"{engine.path}/{name}.jsonl"

    @cached_property
    def commits(self) -> DataFrame:
        """Opened once: lines are parsed, repaired, deduplicated and aged when first asked for."""
        return log.read_log(self.engine.spark, self.path).where(F.col("org").isNull() | (F.col("org") == self.engine.org))

    def forget(self) -> None:
        """What was derived from the log before a write: the next use reads it again."""
        self.__dict__.pop("commits", None)
        self.engine.forget(f"/{self.name}")

    def commits_of(self, key: str) -> DataFrame:
        """Commits of one key, newest first."""
        return self.commits.where(F.col("key") == key).orderBy(*graph.newest_first())

    def commit(self, id: str) -> DataFrame:
        return self.commits.where(F.col("id") == id)

    def ids(self) -> DataFrame:
        return self.commits.select("id")

    def heads(self, connection: str | None = None, session: str | None = None) -> DataFrame:
        return graph.heads(self.commits, connection, session)

    def _typed(self, commits: DataFrame, scheme: Scheme) -> DataFrame:
        """Commits with ``record`` (of full ones) and ``edit`` (changes, of deltas); a delta has the scheme of its base."""
        marks = self.commits.where("base is null").select(F.col("id").alias("_full"), F.col("scheme_ns").alias("_ns"), F.col("scheme_version").alias("_nv"))
        known = commits.join(marks, F.coalesce("base", "id") == F.col("_full"), "left").withColumns({"scheme_ns": F.coalesce("scheme_ns", "_ns"), "scheme_version": F.coalesce("scheme_version", "_nv")})
        full = F.col("base").isNull()
        return known.withColumns({"record": F.when(full, raw_record(F.col("payload"), scheme)), "edit": F.when(~full, change.from_wire(F.col("edit"), scheme.dates()))}).drop("_full", "_ns", "_nv")

    def _values(self, commits: DataFrame, scheme: Scheme) -> DataFrame:
        """Commits with ``value``, the raw record: corrupt deltas take that of the newest good commit of their key."""
        fields = kinds(scheme)
        full = self._typed(self.commits.where("base is null"), scheme)
        got = records.materialise(self._typed(commits, scheme), fields, full)
        bad = got.where("corrupt").select("key").distinct()
        rest = records.materialise(self._typed(graph.readable(self.commits).join(bad, "key", "left_semi"), scheme), fields, full)
        return records.with_fallback(got, rest)

    def items(self, scheme: Scheme) -> DataFrame:
        """Typed view of the current items of a namespace: the scheme filter comes after the choice of heads."""
        rows = self._values(self.heads(), scheme).where((F.col("scheme_ns") == scheme.ns) & ~F.coalesce(F.col("value.isDeleted"), F.lit(False)))
        return rows.withColumn("_v", typed_record("value", scheme)).select("key", "id", "age", "ts", "scheme_ns", "scheme_version", "_v.*")

    def item(self, key: str, scheme: Scheme) -> DataFrame:
        return self.items(scheme).where(F.col("key") == key)

    def keys(self) -> DataFrame:
        return self.commits.select("key").distinct()

    def count(self) -> int:
        """Keys of the repository; -1 if there is no such repository."""
        jvm = self.engine.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.engine.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return -1
        return self.commits.agg(F.count_distinct("key")).first()[0]

    def query(self, scheme: Scheme, predicate=None, sort: list[Column] | None = None, ctx: dict | None = None) -> Query:
        return self.engine.query(self.items(scheme), scheme=scheme.ns, predicate=predicate, sort=sort or [], ctx=ctx or {}, name=f"/{self.name}")

    def _payload(self, rows: DataFrame, scheme: Scheme) -> DataFrame:
        """Adds ``payload`` and the ``record`` and ``checksum`` that a reader will get from it."""
        unknown = set(rows.columns) - set(scheme.all_fields()) - {"key"}
        if unknown:
            raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
        fields = [n for n in scheme.all_fields() if n in rows.columns]
        payload = F.to_json(F.struct(*[_tagged(F.col(f), scheme.all_fields()[f].type).alias(f) for f in fields]))
        made = rows.select(*[c for c in ("key",) if c in rows.columns], payload.alias("payload")).withColumn("record", raw_record(F.col("payload"), scheme))
        return made.withColumn("checksum", records.record_checksum("record", kinds(scheme)))

    def _append(self, rows: DataFrame, scheme: Scheme, session: str, connection: str, label: str) -> DataFrame:
        """Write commits (key, parents, checksum, and payload or base with edit) under new ids, which are drawn once."""
        none = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)
        ident = F.col("id") if "id" in rows.columns else F.uuid().alias("id")
        stamp = [F.lit(session).alias("session"), F.unix_millis(F.current_timestamp()).alias("ts_ms"), F.lit(self.engine.org).alias("org"), F.lit(connection).alias("connection")]
        out = written(rows.select(ident, F.col("key").cast("string").alias("key"), *stamp, "parents", none("payload"), F.lit(scheme.ns).alias("scheme_ns"), F.lit(scheme.version).alias("scheme_version"), none("base"), none("edit"), none("source_checksum"), "checksum", none("merge_base")), label)
        log.append_log(out, None, self.path)
        self.forget()
        return out

    def create(self, rows: DataFrame, scheme: Scheme, session: str = "root", connection: str = "batch") -> DataFrame:
        """Commits for new items (fields of the scheme, and ``key`` or none) written to the log; returns them."""
        keyed = rows if "key" in rows.columns else rows.withColumn("key", F.uuid())
        new = self._payload(keyed, scheme).withColumn("parents", F.array().cast("array<string>"))
        return self._append(new, scheme, session, connection, "created")

    def set_value(self, rows: DataFrame, scheme: Scheme, session: str = "root", connection: str = "batch") -> DataFrame:
        """Commits on top of the heads for keys whose contents changed; equal ones write nothing.

        A commit is a delta against the newest full one of its key where that is short enough, else full.
        """
        fields = kinds(scheme)
        head = self._values(self.heads(), scheme).withColumn("_sum", records.record_checksum("value", fields)).select("key", F.col("id").alias("_head"), "_sum")
        newest = graph.newest_per(self.commits.where("base is null"), "key")
        base = self._typed(newest, scheme).select("key", F.col("id").alias("_base"), F.col("record").alias("_old"), F.col("age"))
        new = self._payload(rows, scheme).join(head, "key", "left").where(~F.col("checksum").eqNullSafe(F.col("_sum"))).join(base, "key", "left")
        edit = change.to_wire(change.diff({n: k for n, (k, _) in fields.items()}, "_old", "record"), {n: f.type for n, f in scheme.all_fields().items()})
        new = new.withColumn("_edit", F.when(F.col("_base").isNotNull(), edit))
        kept = F.coalesce(F.col("_edit").isNotNull() & change.delta_kept(F.col("payload"), F.col("_edit"), F.col("age")), F.lit(False))
        delta = lambda c: F.when(kept, c)
        out = new.select("key", "checksum", F.array_compact(F.array("_head")).alias("parents"), F.when(~kept, F.col("payload")).alias("payload"), delta(F.col("_base")).alias("base"), delta(F.col("_edit")).alias("edit"), delta(records.record_checksum("_old", fields)).alias("source_checksum"))
        return self._append(out, scheme, session, connection, "set")

    def merge(self, scheme: Scheme, session: str = "root", connection: str = "merge") -> DataFrame:
        """Merge commits for keys with several leaves, each relative to the base of its leaves; returns them.

        Leaves that share no base with the others are not parents of the merge, so they stay leaves.
        """
        fields = kinds(scheme)
        leaves = graph.leaves(self.commits)
        many = leaves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        leaves = written(leaves.join(many, "key", "left_semi"), "merge-leaves")
        state = graph.merge_bases(self.commits, leaves)
        chosen = state.where(F.size("merged") > 1).select("key", "base", F.explode("merged").alias("id"))
        values = written(self._values(self.commits.join(chosen.select("id").union(chosen.select("base")).distinct(), "id", "left_semi"), scheme).select("id", "key", "ts", "parents", "value", "scheme_ns"), "merge-values")
        own = values.where(F.col("scheme_ns") == scheme.ns)
        tips = own.join(chosen.select("id"), "id", "left_semi").select("id", "key", "ts", (F.size("parents") == 0).alias("is_root"), "value.*")
        base = own.join(chosen.select("key", F.col("base").alias("id")).distinct(), ["key", "id"], "left_semi").select("key", "value.*")
        merged = merge.merge_records(tips, base, {n: k for n, (k, _) in fields.items()})
        commits = merge.merge_commits(merged, tips)
        typed = commits.select("id", "key", "parents", F.struct(*fields).alias("_r")).withColumn("_r", typed_record("_r", scheme)).select("id", "key", "parents", "_r.*")
        new = self._payload(typed.drop("id", "parents"), scheme)
        ready = new.join(typed.select("id", "key", "parents"), "key").join(chosen.select("key", F.col("base").alias("merge_base")).distinct(), "key")
        return self._append(ready, scheme, session, connection, "merged")


def _tagged(value: Column, kind: str) -> Column:
    """Dates and sets carry a tag in JSON."""
    if kind == "date":
        return F.when(value.isNotNull(), F.struct(F.lit("D").alias("__t"), (F.unix_millis(value) / 1000).alias("__v")))
    if kind == "set":
        return F.when(value.isNotNull(), F.struct(F.lit("S").alias("__t"), F.array_sort(value).alias("__v")))
    return value
