"""Exact dedup against a persistent digest index that is bucketed and sorted by hash. DataFrame operations only.

The index is a few generations of (digest, keep_id, group_size, seq), each one sorted file a bucket, so the
anti-join of new digests reads a generation without a shuffle or a sort and merges. A batch adds a generation; two
neighbours are merged when the newer has reached half the rows of the older, so there are at most logarithmically
many and a row is rewritten as often. New data is reduced to one row per digest before it meets the index, so a
group that holds a third of all rows costs one row per map task there, and it is salted where rows fetch their
group's decision. Texts never move: only digests and ids are shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import ascii_lower, children, exists, remove, salted_join, scratch_root, table

BUCKET_ROWS = 1_000_000  # digests to a bucket, about 50 MB
SORTED_READ = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # lets a plan use the order of one-file buckets


def text_digest() -> Column:
    """SHA-256 of text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


@dataclass(frozen=True)
class Generation:
    """The digests of batches lo to hi. Its folder's name holds all of this."""

    lo: int
    hi: int
    buckets: int
    rows: int

    @property
    def folder(self) -> str:
        return f"g-{self.lo:06d}-{self.hi:06d}-{self.buckets}-{self.rows}"


class DigestIndex:
    """A persistent index of texts already seen, for one writer at a time.

    path is a folder on shared storage; opening an existing one continues it. A generation counts from the moment its
    batch is marked, so a batch that was cut short leaves no trace. buckets fixes the number of buckets; by default it
    follows the rows of each generation.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.batches = {k: int(n) for n, k in (x.split("-", 1) for x in children(spark, f"{path}/batches"))}

    def generations(self) -> list[Generation]:
        """Valid generations in order; one that a merged generation covers is left out."""
        last = max(self.batches.values(), default=0)
        found = [Generation(*map(int, x.split("-")[1:])) for x in children(self.spark, self.path) if x.startswith("g-")]
        found = [g for g in found if g.hi <= last and exists(self.spark, f"{self.path}/{g.folder}/_SUCCESS")]
        return sorted((g for g in found if not any(o.lo <= g.lo and g.hi <= o.hi and o != g for o in found)), key=lambda g: g.lo)

    def _name(self, g: Generation) -> str:
        return f"codelode_digests_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{g.folder}').hex}"

    def read(self, g: Generation) -> DataFrame:
        """A generation as a bucketed table."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(g)} (digest BINARY, keep_id BIGINT, group_size BIGINT, seq INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {g.buckets} BUCKETS LOCATION '{self.path}/{g.folder}'"
        )
        return self.spark.table(self._name(g))

    def drop(self) -> None:
        """Delete the index."""
        for g in self.generations():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(g)}")
        remove(self.spark, self.path)

    def _write(self, df: DataFrame, lo: int, hi: int, rows: int) -> Generation:
        g = Generation(lo, hi, self.buckets or max(1, -(-rows // BUCKET_ROWS)), rows)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(g)}")
        remove(self.spark, f"{self.path}/{g.folder}")
        df.repartition(g.buckets, "digest").write.bucketBy(g.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{g.folder}").saveAsTable(self._name(g))
        return g

    def _merge(self) -> None:
        gens = self.generations()
        while len(gens) > 1 and gens[-1].rows * 2 >= gens[-2].rows:
            old, new = gens[-2:]
            self._write(self.read(old).unionByName(self.read(new)), old.lo, new.hi, old.rows + new.rows)
            for g in (old, new):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(g)}")
                remove(self.spark, f"{self.path}/{g.folder}")
            gens = self.generations()

    def fresh(self, groups: DataFrame, seq: int) -> DataFrame:
        """The rows of groups(digest, ...) whose digest no batch before seq has: one merge anti-join a generation."""
        for g in self.generations() or [None]:
            old = self.spark.createDataFrame([], "digest binary, seq int") if g is None else self.read(g)
            groups = groups.join(old.where(F.col("seq") < seq).select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate docs against the index and within themselves, and append what is new.

        Returns (doc_id, digest, keep_id, group_size, kept) for every row. In a batch the largest doc_id of equal
        texts stays; a text the index already has is dropped whole, with the index's keep_id and the size its
        first batch gave. A batch that comes again under its name meets only what was there before it and gives the
        same result, so a lost job can be repeated. Null ids lose to any id; a group of null ids only keeps them
        (null equals null). Rows that repeat id and text are one document and share its decision. Other columns are
        not read. An empty batch appends nothing.
        """
        key = uuid.uuid5(uuid.NAMESPACE_OID, batch).hex if batch is not None else uuid.uuid4().hex
        again = key in self.batches
        seq = self.batches.get(key) or max(self.batches.values(), default=0) + 1
        rows, _ = table(digests(docs), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        before = self.spark.conf.get(SORTED_READ)
        self.spark.conf.set(SORTED_READ, "true")
        try:
            fresh, _ = table(self.fresh(groups, seq).withColumn("group_size", F.col("n")), "fresh-digests")
            verdicts = [fresh.withColumn("new", F.lit(True))]
            for g in self.generations():
                old = self.read(g).where(F.col("seq") < seq).select("digest", F.col("keep_id").alias("had"), "group_size").hint("merge")
                verdicts.append(groups.join(old, "digest").select("digest", F.col("had").alias("keep_id"), "n", "group_size", F.lit(False).alias("new")))
            verdict, _ = table(reduce(DataFrame.unionByName, verdicts), "verdicts")
            if not again:
                n = fresh.count()
                if n:
                    self._write(fresh.select("digest", "keep_id", "group_size", F.lit(seq).alias("seq")), seq, seq, n)
                mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{seq:06d}-{key}")
                mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(mark)
                self.batches[key] = seq
                self._merge()
        finally:
            self.spark.conf.set(SORTED_READ, before)
        kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return salted_join(rows, verdict, ["digest"], "n", "doc_id").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document with its decision; a fresh index unless a path is given."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_path or f"{scratch_root(spark)}/codelode/digest-index-{uuid.uuid4().hex}")
    out = index.add(docs, batch)
    if index_path is None:
        index.drop()  # the result reads its verdicts, not the index
    return out


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document against a fresh index."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
