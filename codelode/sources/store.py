"""A store: the index tables as Parquet under one folder, registered as views."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelode.functions import text
from codelode.operators import search
from codelode.sources import dialect, recursive
from codelode.sources.catalog import file_state
from codelode.sources.fulltext import FullText

SCHEMAS = {
    "files": "id long, path string, ext string, size long, mtime long, content string",
    "symbols": "id long, file_id long, name string, kind string, lang string, start_line long, end_line long, start_byte long, end_byte long, parent_id long, attrs map<string,string>, provenance array<string>",
    "edges": "id long, file_id long, src_symbol_id long, dst_symbol_id long, dst_name string, relation string",
    "meta": "key string, value string",
    "query_log": "id long, ts long, project string, db_path string, sql_text string, kind string, task_tag string, valid_date string, file_state array<struct<path:string,mtime:long,size:long>>",
    "query_notes": "id long, log_id long, note string, tag string, status string, created_at long",
}


class Store:
    """Opens or makes a store. Tables that are not there read as empty; a store to be read must be there."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        if read_only and not any(self.has(name) for name in SCHEMAS):
            raise FileNotFoundError(f"no store in {path}")

    def has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(SCHEMAS[name])
        if not self.has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        if self.read_only:
            raise PermissionError("the store is open for reading")
        # what is appended has a folder of its own, so that several writers can append at once
        at = f"{self.path}/{name}" + (f"/batch-{uuid.uuid4().hex}" if mode == "append" else "")
        rows.select(*StructType.fromDDL(SCHEMAS[name]).fieldNames()).write.mode(mode).parquet(at)

    def register(self) -> None:
        for name in SCHEMAS:
            rows = self.table(name)
            if "id" in rows.columns:
                rows = rows.withColumn("rowid", F.col("id"))
            rows.createOrReplaceTempView(name)
        self.table("files").select(F.col("id").alias("rowid"), "path", "content").createOrReplaceTempView("files_fts")
        text.register(self.spark)

    def query(self, statement: str, log=None) -> DataFrame:
        """A statement in the dialect of the file-based store (see dialect); log(statement) is told of it first."""
        if log:
            log(statement)
        return recursive.run(dialect.rewrite(statement, self._matched), self.sql)

    def logged(self, statement: str, project: str = "", kind: str = "dynamic", task_tag: str | None = None, root: str | None = None) -> DataFrame:
        """A statement's rows, once a row of the query log has been written for it.

        A dynamic row carries the day and the state of the files that the statement's literals name, as they are under
        root or, without one, as they were indexed; a static row neither. Rows are appended and their ids made of the time and a random part, so any
        number of writers may log at once.
        """
        out = self.query(statement)
        now = time.time()
        number = int(now * 1000) << 20 | secrets.randbits(20)
        said = self.spark.createDataFrame([(number, statement)], "id long, sql_text string")
        row = said.select("id", F.lit(int(now)).cast("long").alias("ts"), F.lit(project).alias("project"), F.lit(self.path).alias("db_path"), "sql_text", F.lit(kind).alias("kind"), F.lit(task_tag).cast("string").alias("task_tag"))
        if kind == "dynamic":
            files = self.table("files")
            named = search.referenced_paths(said, files)
            state = file_state(self.spark, named, root) if root else named.join(files.select("path", "mtime", "size"), "path", "left")
            states = state.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "mtime", "size"))).alias("file_state"))
            none = F.array().cast(StructType.fromDDL(SCHEMAS["query_log"])["file_state"].dataType)
            row = row.join(states, "id", "left").withColumn("file_state", F.coalesce("file_state", none)).withColumn("valid_date", F.lit(time.strftime("%Y-%m-%d", time.localtime(now))))
        else:
            row = row.withColumn("valid_date", F.lit(None).cast("string")).withColumn("file_state", F.lit(None).cast(StructType.fromDDL(SCHEMAS["query_log"])["file_state"].dataType))
        self.write("query_log", row.coalesce(1), mode="append")
        return out

    def index_text(self) -> FullText:
        """The full-text index of the files as they are, made anew beside the tables."""
        if self.read_only:
            raise PermissionError("the store is open for reading")
        index = FullText(self.spark, f"{self.path}/fulltext")
        had = index.statistics()[0] if index.generations else 0
        if had:
            index.remove(self.spark.read.parquet(*[f"{self.path}/fulltext/generations/{g}/files" for g in index.generations]).select(F.col("file_id").alias("id")).distinct())
        index.put(self.table("files"))
        return index

    def _matched(self, query: str) -> str:
        """A view of files_fts with the rows that match a query and their rank, through the stored index if there is one."""
        files = self.table("files")
        index = FullText(self.spark, f"{self.path}/fulltext") if self.has("fulltext/versions") else None
        if index and index.generations:
            found = index.ranked(files, query)
        else:
            size = sum(F.greatest(F.length(c) - 2, F.lit(0)) for c in ("path", "content"))
            n, mean = files.agg(F.count("*"), F.avg(size)).first()
            tree = search.parse(query)
            found = search.bm25(files, tree, n, mean or 1.0) if tree else files.select("*", F.lit(0.0).alias("rank")).where(F.lit(False))
        name = f"files_fts_{hashlib.sha1(query.encode()).hexdigest()[:16]}"
        found.select(F.col("id").alias("rowid"), "path", "content", "rank").createOrReplaceTempView(name)
        return name

    def sql(self, statement: str) -> DataFrame:
        """One read-only statement over the registered tables; anything whose parsed plan has a command in it is refused."""
        self.register()
        if not self._reads_only(statement):
            raise ValueError("only queries are accepted")
        return self.spark.sql(statement)

    def _reads_only(self, statement: str) -> bool:
        """Whether no node of the parsed plan is a command or a statement of its own kind, by class."""
        kind = self.spark._jvm.java.lang.Class.forName
        plans = "org.apache.spark.sql.catalyst.plans.logical."
        bad = [kind(plans + "Command"), kind(plans + "ParsedStatement")]
        todo = [self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
        while todo:
            node = todo.pop()
            if any(b.isInstance(node) for b in bad):
                return False
            below = node.children()
            todo += [below.apply(k) for k in range(below.size())]
        return True

    def copy_from(self, other: "Store") -> None:
        """Take over all tables of another store."""
        for name in SCHEMAS:
            if other.has(name):
                self.write(name, other.table(name))

    # slices of a fingerprint of the store: a changed store has another fingerprint, so nothing stale is read
    def fingerprint(self) -> str:
        """First 16 digits of a digest of files and counts, from sums that do not depend on order."""
        f = self.table("files").agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("path", "size", "mtime").cast("decimal(38,0)")), F.lit(0))).first()
        e = self.table("edges").agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src_symbol_id", "dst_symbol_id", "dst_name", "relation").cast("decimal(38,0)")), F.lit(0))).first()
        return hashlib.sha1(repr((*f, *e)).encode()).hexdigest()[:16]

    def cached_slice(self, key: str, make):
        """(nodes, edges) kept under a cache key, made by make() and written the first time."""
        at = [f"cache/{key}/{part}" for part in ("nodes", "edges")]
        if not all(self.has(f"{x}/_SUCCESS") for x in at):
            for frame, x in zip(make(), at):
                frame.write.mode("overwrite").parquet(f"{self.path}/{x}")
        return tuple(self.spark.read.parquet(f"{self.path}/{x}") for x in at)


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """The later value of each key."""
    both = meta.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "_n").alias("value"))


def cache_key(fingerprint: str, seed: str, max_nodes: int, max_depth: int, direction: str) -> str:
    """First 16 hex digits of the SHA-1 of the sorted JSON of a slice request."""
    doc = {"fp": fingerprint, "seed": seed, "max_nodes": max_nodes, "max_depth": max_depth, "direction": direction}
    return hashlib.sha1(json.dumps(doc, sort_keys=True).encode()).hexdigest()[:16]
