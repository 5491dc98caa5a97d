"""A stored full-text index: trigram postings in buckets, in generations that are merged as they grow in number.

    <path>/generations/<name>/postings/bucket=<b>/   gram, file_ids: lists of a block of files each; sorted by gram in a bucket
    <path>/generations/<name>/files/                 file_id, tokens (null: the file has gone)
    <path>/versions/<n>/                             the generations of version n, oldest first, the number of buckets and the layout

A query's grams name the buckets to read; the order inside a bucket lets row groups be passed over. A change writes a
generation of its own and then a version that names it, so readers see either the old or the new state and a broken
change leaves the old one. A file's newest generation counts. An index of an older layout opens as one without generations.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import search

BUCKETS = 64
GENERATIONS = 4  # more are merged into one
LIST = 4096  # files of a list, about, when generations are merged
LAYOUT = 2  # 1, or none written: a row for each posting
VERSION = "number int, generation string, buckets int, layout int"
LISTS = "gram string, file_ids array<long>"
#: Ids as differences: lists are in the order of their files, and a dictionary of ids would be given up in a larger bucket.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#file_ids.list.element": "false"}


def bucket_of(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


class FullText:
    """Opens an index, or makes an empty one with the given number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(x.getPath().getName()) for x in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if fs.exists(p) else []
        self.version, self.generations, self.buckets = max(done, default=0), [], buckets
        if done:
            rows = spark.read.schema(VERSION).parquet(f"{self.path}/versions/{self.version}").orderBy("number").collect()  # a few generations
            self.generations, self.buckets = [r.generation for r in rows if r.generation and r.layout == LAYOUT], rows[0].buckets

    def _at(self, name: str, part: str) -> str:
        return f"{self.path}/generations/{name}/{part}"

    def _commit(self, generations: list[str]) -> None:
        rows = [(k, g, self.buckets, LAYOUT) for k, g in enumerate(generations)] or [(0, None, self.buckets, LAYOUT)]
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(f"{self.path}/versions/{self.version + 1}")  # fails if another writer was first
        self.version, self.generations = self.version + 1, generations

    def _write(self, postings: DataFrame, files: DataFrame) -> str:
        """A new generation of postings(gram, file_ids) and files(file_id, tokens)."""
        name = uuid.uuid4().hex
        placed = postings.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(self.buckets)).cast("int"))
        # adaptive execution deals a large bucket to several tasks, each of which writes a sorted file of it
        placed.hint("rebalance", self.buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").options(**PACKED).parquet(self._at(name, "postings"))
        files.write.parquet(self._at(name, "files"))
        return name

    def put(self, files: DataFrame) -> None:
        """Add files(id, path, content), or new contents of files that are there."""
        length = lambda c: F.greatest(F.length(c) - 2, F.lit(0))
        sizes = files.select(F.col("id").alias("file_id"), (F.coalesce(length("path"), F.lit(0)) + F.coalesce(length("content"), F.lit(0))).cast("long").alias("tokens"))
        self._add(self._write(search.posting_lists(files), sizes))

    def remove(self, ids: DataFrame) -> None:
        """Take out the files of ids(id)."""
        none = self.spark.createDataFrame([], LISTS)
        self._add(self._write(none, ids.select(F.col("id").alias("file_id"), F.lit(None).cast("long").alias("tokens"))))

    def _add(self, name: str) -> None:
        if len(self.generations) < GENERATIONS:
            self._commit([*self.generations, name])
        else:
            self.merge(name)

    def merge(self, *more: str) -> None:
        """All generations as one; postings of files that have gone or changed since are left behind."""
        names = [*self.generations, *more]
        live = self._newest(names).where("tokens IS NOT NULL")
        kept = self._lists(names).select("gram", "gen", F.explode("file_ids").alias("file_id")).join(live.select("file_id", "gen"), ["file_id", "gen"], "left_semi")
        part = F.pmod(F.xxhash64("file_id"), F.lit(live.count() // LIST + 1))
        lists = kept.groupBy("gram", part.alias("part")).agg(F.sort_array(F.collect_list("file_id")).alias("file_ids"))
        self._commit([self._write(lists.select("gram", "file_ids"), live.select("file_id", "tokens"))])

    def _newest(self, names: list[str]) -> DataFrame:
        """(file_id, gen, tokens): each file's newest generation."""
        rows = self._parts(names, "files", "file_id long, tokens long")
        if len(names) < 2:
            return rows.select("file_id", "gen", "tokens")
        return rows.groupBy("file_id").agg(F.max_by("tokens", "gen").alias("tokens"), F.max("gen").alias("gen")).select("file_id", "gen", "tokens")

    def _lists(self, names: list[str]) -> DataFrame:
        return self._parts(names, "postings", LISTS + ", bucket int")

    def _parts(self, names: list[str], part: str, schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema).withColumn("gen", F.lit(0))
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(self._at(name, part)).withColumn("gen", F.lit(k)) for k, name in enumerate(names)])

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, file_id) of the given grams; only their buckets are read."""
        lists = self._lists(self.generations).where(F.col("bucket").isin(sorted({bucket_of(g, self.buckets) for g in grams})) & F.col("gram").isin(grams))
        some = lists.select("gram", "gen", F.explode("file_ids").alias("file_id"))
        if len(self.generations) > 1:
            some = some.join(self._newest(self.generations).where("tokens IS NOT NULL").select("file_id", "gen"), ["file_id", "gen"], "left_semi")
        return some.select("gram", "file_id")

    def statistics(self) -> tuple[int, float]:
        """(files, mean length in trigrams)."""
        n, mean = self._newest(self.generations).where("tokens IS NOT NULL").agg(F.count("*"), F.avg("tokens")).first()
        return n, mean or 0.0

    def match(self, files: DataFrame, query: str) -> DataFrame:
        """The files(id, path, content, ...) that match a term query; only candidates by trigrams are compared."""
        tree = search.parse(query)
        if tree is None:
            return files.where(F.lit(False))
        found = search.candidates(self.postings(sorted({g for t in search.terms_of(tree) for g in search.grams_of(t)})), tree)
        return files.join(found, files.id == found.file_id, "left_semi").where(search.decide(tree, search.has_term))

    def ranked(self, files: DataFrame, query: str) -> DataFrame:
        """(id, path, content, rank) of the files that match a term query."""
        tree = search.parse(query)
        words = search.terms_of(tree)
        if tree is None:
            return files.select("id", "path", "content", F.lit(0.0).alias("rank")).where(F.lit(False))
        any_term = ("or", [("term", t) for t in words])
        found = search.candidates(self.postings(sorted({g for t in words for g in search.grams_of(t)})), any_term)
        total, mean = self.statistics()
        return search.bm25(files, tree, total, mean or 1.0, found)
