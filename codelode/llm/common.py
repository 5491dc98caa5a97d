"""Plumbing shared by the llm operators: shared scratch tables and streaming over sorted groups."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "codelode-scratch")
    return root.rstrip("/")


def table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut lineage: write df to the shared scratch folder and read it back. Returns (frame, path)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/codelode/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Hand memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of shared storage; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


FAR = 1 << 62  # surrogate keys of rows without an id start here, after all ids in use


def row_key(name, content):
    """The id of a row; rows without one get a number made of their content, above all ids, so equal ones share it."""
    return F.coalesce(name, F.shiftrightunsigned(F.xxhash64(content), 2) + F.lit(FAR))


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], count: str, spread: str, parts: int = 1000) -> DataFrame:
    """Inner join of rows with small on keys, small (a stored table) having one row a key and in ``count`` the rows it meets.

    Keys that meet over a share 1 / parts of all rows are at most ``parts`` in number whatever the data, so they can
    be broadcast; each is dealt by a hash of ``spread`` over as many salts as it has such shares. No task of the
    merge join then gets more of one key than that share, with or without adaptive execution.
    """
    total = small.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    share = max(1, total // parts)
    hot = small.where(F.col(count) > share).select(*keys, F.ceil(F.col(count) / share).cast("int").alias("_salts"))
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    last = F.when(F.col(count) > share, F.ceil(F.col(count) / share).cast("int") - 1).otherwise(0)
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return rows.join(dealt, [*keys, "_salt"]).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z only. Pure ASCII values take the fast path, where lower() means the same."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows and, but for single rows, of at most ``most`` bytes; gives unused memory back.

    A worker holds the Python objects of one part, which long texts and long lists would swell at any row count.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > most:
                n = -(-n // 2)
            yield batch.slice(at, n)
            at += n
        pa.default_memory_pool().release_unused()


def rows_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches sorted by keys so that no group is cut; holds one group besides the batch at hand."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            last |= v != v[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if held:
            same = all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in keys)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component label (an index) of each of n nodes under the given links, by label propagation with pointer jumping."""
    label = np.arange(n)
    while left.size:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label
