"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

The exact state is a set of postings (key, doc_id); reference counts are kept per key. Each shard of the key
space has a cuckoo filter of its repeated keys, those found in two documents or more. Documents are cleaned by
sending their distinct keys to the filter of their shard and checking the hits against the exact counts, so a
false positive costs a lookup and never a line. Inserting raises counts and adds keys to the filters; deleting
lowers counts and takes them out. Hot keys are salted where postings meet counts (``salted_join``).
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import children, exists, remove, row_key, rows_of, salted_join, scratch_root, shuffle_width, slices, table

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
SHARD_KEYS = 100_000
POSTINGS, COUNTS, FILTERS = "doc long, h1 long, h2 long", "h1 long, h2 long, n_docs long, min_doc long, max_doc long", "shard int, cells binary"
REPEATED = "n_docs > 1"


class Cuckoo:
    """A cuckoo filter of 64-bit hashes with 16-bit fingerprints, four to a bucket, on numpy arrays."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))), SLOTS), np.uint16))

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter of the given distinct hashes; grows until all fit."""
        made = cls.sized(hashes.size)
        while not made.insert(hashes):
            made = cls(np.zeros((2 * len(made.cells), SLOTS), np.uint16))
        return made

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _homes(self, h: np.ndarray):
        h = h.astype(np.uint64)
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (h & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return fp, one, self._other(fp, one)

    def _other(self, fp: np.ndarray, home: np.ndarray) -> np.ndarray:
        return home ^ (fp.astype(np.int64) * 0x5BD1E995 & len(self.cells) - 1)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._homes(h)
        return (self.cells[one] == fp[:, None]).any(axis=1) | (self.cells[two] == fp[:, None]).any(axis=1)

    def insert(self, h: np.ndarray, rounds: int = 2000) -> bool:
        """Add hashes, a bucket at most once a round; False if they do not fit (the filter is then unusable)."""
        fp, at, _ = self._homes(h)
        tries = np.zeros(fp.size, np.int64)
        for turn in range(rounds):
            if not fp.size:
                return True
            _, pick = np.unique(at, return_index=True)
            free = self.cells[at[pick]] == 0
            room = free.any(axis=1)
            put = pick[room]
            self.cells[at[put], free[room].argmax(axis=1)] = fp[put]
            stuck = pick[~room]
            kick = stuck[tries[stuck] % 2 == 1]
            slot = (turn + kick) % SLOTS
            fp[kick], self.cells[at[kick], slot] = self.cells[at[kick], slot], fp[kick]
            at[stuck] = self._other(fp[stuck], at[stuck])
            tries[stuck] += 1
            left = np.ones(fp.size, bool)
            left[put] = False
            fp, at, tries = fp[left], at[left], tries[left]
        return not fp.size

    def delete(self, h: np.ndarray) -> None:
        """Take out hashes that were inserted, one copy each."""
        for fp, one, two in zip(*(x.tolist() for x in self._homes(h))):
            for home in (one, two):
                hit = np.flatnonzero(self.cells[home] == fp)
                if hit.size:
                    self.cells[home, hit[0]] = 0
                    break


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key, or None for keys under min_chars code points."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, h1, h2): the distinct long keys of every row; doc is doc_id, or a number made of the text where it is null."""

    def run(batches):
        for b in slices(batches):
            names, digests = [], []
            for name, text in zip(b.column("doc").to_pylist(), rows_of(b, "t"), strict=True):
                found = {d for line in text.split(b"\n") if (d := key_digest(line, min_chars))}
                names += [name] * len(found)
                digests += found
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(np.ascontiguousarray(h[:, k])) for k in (0, 1))], ["doc", "h1", "h2"])

    return texts_of(docs).select("doc", "t").mapInArrow(run, "doc long, h1 long, h2 long")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, t): id as given, key of the row, text."""
    name, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(name.alias("doc_id"), row_key(name, text).alias("doc"), text.alias("t"))


class LineIndex:
    """State of the lines of a growing and shrinking corpus in a folder of shared storage.

    Each change writes a version: ``counts`` (h1, h2, n_docs, min_doc, max_doc), exact; ``filters`` (shard, cells),
    one cuckoo filter for the keys of a shard that two documents or more hold; ``postings`` (doc, h1, h2) of an
    insertion or ``gone`` (doc) of a deletion; last of all ``meta``, which makes the version valid, so a change
    that was cut short leaves the one before. Opening a folder again continues at its last version. The number of
    shards is a power of two that doubles with the distinct keys, so that a shard has SHARD_KEYS to twice as many of
    them to count and probe, and its filter fewer.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_chars, self.shard_keys = spark, min_chars, shard_keys
        self.path = path or f"{scratch_root(spark)}/codelode/line-index-{uuid.uuid4().hex}"
        valid = [v for v in children(spark, self.path) if exists(spark, f"{self.path}/{v}/meta/_SUCCESS")]
        self.version, self.shards, self.steps = 0, 1, []
        if valid:
            meta = spark.read.parquet(f"{self.path}/{valid[-1]}/meta").first()
            if meta.min_chars != min_chars:
                raise ValueError(f"the index was made with min_chars={meta.min_chars}")
            self.version, self.shards, self.steps = meta.version, meta.shards, [tuple(x) for x in meta.steps]

    def _read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version if version is None else version:08d}/{name}")

    @property
    def counts(self) -> DataFrame | None:
        return self._read("counts", COUNTS) if self.version else None

    @property
    def filters(self) -> DataFrame | None:
        return self._read("filters", FILTERS) if self.version else None

    @property
    def postings(self) -> DataFrame | None:
        """(doc, h1, h2) of the documents the index holds: every insertion without what was deleted after it."""
        made = [self._read("postings", POSTINGS, v).withColumn("v", F.lit(v)) for v, kind in self.steps if kind == "insert"]
        if not made:
            return None
        live = reduce(DataFrame.unionByName, made)
        cut = [self._read("gone", "doc long", v).select(F.col("doc").alias("_d"), F.lit(v).alias("_v")) for v, kind in self.steps if kind == "delete"]
        if cut:
            live = live.join(reduce(DataFrame.unionByName, cut), (F.col("doc") == F.col("_d")) & (F.col("v") < F.col("_v")), "left_anti")
        return live.drop("v")

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        return postings.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("min_doc"), F.max("doc").alias("max_doc"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents. Rows that repeat an id are one document, and keys the index already has of it do not count again."""
        new = line_keys(docs, self.min_chars).distinct()
        have = self.postings
        if have is not None:
            new, _ = table(new, "line-keys")
            new = new.join(have.join(new.select("doc").distinct(), "doc", "left_semi"), ["doc", "h1", "h2"], "left_anti")
        self._commit("insert", "postings", new)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents of ids(doc_id); counts and filters become what they were without them."""
        gone = ids.select(F.col("doc_id").cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
        self._commit("delete", "gone", gone)

    def _commit(self, kind: str, name: str, change: DataFrame) -> None:
        """Write the next version: the change, the counts and filters it leads to, and the mark that makes it valid."""
        was, old, old_filters, before, shards = self.version, self.counts, self.filters, self.postings, self.shards
        at = f"{self.path}/v{was + 1:08d}"
        remove(self.spark, at)  # what a change that was cut short has left

        def put(df: DataFrame, part: str) -> DataFrame:
            df.write.option("compression", "zstd").parquet(f"{at}/{part}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{part}")

        change = put(change, name)
        self.version, self.steps = was + 1, [*self.steps, (was + 1, kind)]
        try:
            if kind == "insert":
                counts = self._count(change)
                if old is not None:
                    counts = old.unionByName(counts).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"))
            elif old is not None:
                # a key that lost a document is counted again from its postings
                touched = before.join(change, "doc", "left_semi").select("h1", "h2").distinct()
                counts = old.join(touched, ["h1", "h2"], "left_anti").unionByName(self._count(self.postings.join(touched, ["h1", "h2"], "left_semi")))
            else:
                counts = self.spark.createDataFrame([], COUNTS)
            counts = put(counts, "counts")
            now = counts.where(REPEATED).select("h1", "h2")
            n = counts.count()
            while n > 2 * self.shard_keys * self.shards:
                self.shards *= 2
            if old is None or self.shards != shards:
                put(self._built(now), "filters")
            else:
                had = old.where(REPEATED).select("h1", "h2")
                moved = now.join(had, ["h1", "h2"], "left_anti").withColumn("sign", F.lit(1)).unionByName(had.join(now, ["h1", "h2"], "left_anti").withColumn("sign", F.lit(-1)))
                put(self._updated(old_filters, moved, now), "filters")
            meta = self.spark.createDataFrame([(self.version, self.shards, self.min_chars, self.steps)], "version int, shards int, min_chars int, steps array<struct<v:int,kind:string>>")
            meta.coalesce(1).write.parquet(f"{at}/meta")
        except BaseException:
            self.version, self.steps, self.shards = was, self.steps[:-1], shards
            raise

    def _shard(self):
        return F.col("h2").bitwiseAND(self.shards - 1).cast("int")

    def _built(self, keys: DataFrame) -> DataFrame:
        """A filter for every shard that has keys."""

        def build(key, rows):
            h = np.unique(rows.column("h1").to_numpy()).astype(np.uint64)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([Cuckoo.of(h).dump()], pa.binary())})

        return keys.withColumn("shard", self._shard()).groupBy("shard").applyInArrow(build, FILTERS)

    def _updated(self, filters: DataFrame, moved: DataFrame, now: DataFrame) -> DataFrame:
        """The filters after keys came (sign 1) and went (-1); one that overflows is built anew from the exact counts."""

        def update(key, have, rows):
            made = Cuckoo.load(have.column("cells")[0].as_py()) if have.num_rows else Cuckoo.sized(rows.num_rows)
            h, sign = rows.column("h1").to_numpy().astype(np.uint64), rows.column("sign").to_numpy()
            made.delete(h[sign < 0])
            cells = made.dump() if made.insert(h[sign > 0]) else b""
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells], pa.binary())})

        moved = moved.withColumn("shard", self._shard())
        made, _ = table(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, FILTERS), "line-filters")
        full = made.where(F.length("cells") == 0).select("shard")
        again = self._built(now.withColumn("shard", self._shard()).join(full, "shard", "left_semi").drop("shard"))
        return made.where(F.length("cells") > 0).unionByName(again)

    def _probe(self, keys: DataFrame) -> DataFrame:
        """(h1, h2) of distinct keys that the filter of their shard has.

        A filter travels to the keys of its shard and precedes them in their partition, so a task holds one filter
        and one batch of keys.
        """
        none = F.lit(None)
        first = self.filters.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), "cells")
        rest = keys.select(self._shard().alias("shard"), F.lit(1).alias("kind"), "h1", "h2", none.cast("binary").alias("cells"))

        def run(batches):
            shard, held = None, None
            for b in batches:
                s, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
                h = pc.fill_null(b.column("h1"), 0).to_numpy().view(np.uint64)
                edges = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (kind[1:] != kind[:-1]), True])
                keep = np.zeros(b.num_rows, bool)
                for x, y in zip(edges.tolist(), edges[1:].tolist()):
                    if kind[x] == 0:
                        shard, held = s[x], Cuckoo.load(b.column("cells")[x].as_py())
                    elif shard == s[x] and held is not None:
                        keep[x:y] = held.contains(h[x:y])
                yield b.select(["h1", "h2"]).filter(pa.array(keep))

        both = first.unionByName(rest)
        return both.repartition(max(shuffle_width(self.spark), self.shards), "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "h1 long, h2 long")

    def repeated_lines(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """(doc, drops): keys each document loses, those that another, smaller doc holds. keys: the documents' postings if at hand."""
        if keys is None:
            keys, _ = table(line_keys(docs, self.min_chars).distinct(), "line-keys")
        found = self._probe(keys.select("h1", "h2").distinct())
        held, _ = table(self.counts.where(REPEATED).join(found, ["h1", "h2"]).select("h1", "h2", "n_docs", "min_doc"), "line-hits")
        lost = salted_join(keys, held, ["h1", "h2"], "n_docs", "doc").where("doc <> min_doc")
        return lost.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))

    def clean(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) for every row of docs, which the index must hold."""
        min_chars = self.min_chars

        def run(batches):
            for b in slices(batches):
                lines_n, dropped_n, kept = [], [], []
                for text, drops in zip(rows_of(b, "t"), b.column("drops").to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    if drops:
                        gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drops}
                        stay = [x for x in lines if key_digest(x, min_chars) not in gone]
                    else:
                        stay = lines
                    lines_n.append(len(lines))
                    dropped_n.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "text"],
                )

        joined = texts_of(docs).join(self.repeated_lines(docs, keys), "doc", "left")
        return joined.select("doc_id", "t", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, path: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document without the lines a smaller doc_id holds, through a new index.

    Null and empty texts are one empty line. Rows with a null doc_id come after all ids, equal texts among them as
    one document; rows that repeat an id are one document. Ties do not arise: the smallest id keeps. Only doc_id
    and text are read; an empty table gives an empty result. The index stays in path for later changes.
    """
    index = LineIndex(docs.sparkSession, path, min_chars)
    index.insert(docs)
    return index.clean(docs, index.postings)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup over all documents through a fresh index."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, g.keeper IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
