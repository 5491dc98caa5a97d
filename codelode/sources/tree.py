"""Reading a source tree into the files table."""

from __future__ import annotations

import os
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import paths
from codelode.operators.parse import LANGUAGES
from codelode.scratch import cut
from codelode.sources import catalog

MAX_BYTES = 4 * 1024 * 1024
# Folders that a walk never enters.
SKIP_DIRS = (".git", "node_modules", "dist", ".venv", "venv", "__pycache__")
STORE_DIRS = (".codelode", "codelode")  # where stores are kept in a tree; a setting of read_files
EXTENSIONS = tuple(sorted({*LANGUAGES, *(e for group in catalog.EXTENSIONS.values() for e in group)}))


def is_git_repo(root: str) -> bool:
    try:
        got = subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True, check=False)
    except OSError:
        return False
    return got.returncode == 0 and got.stdout.strip() == "true"


def git_paths(root: str) -> list[str]:
    """Tracked and unignored untracked files, each once, in the order git lists them."""
    got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True)
    return list(dict.fromkeys(p.decode("utf-8", "replace") for p in got.stdout.split(b"\0") if p))


def walked_paths(root: str, skip: tuple[str, ...]) -> list[str]:
    """Files under root, without entering the folders to skip."""
    out = []
    for at, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skip)
        out += [os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for n in names]
    return sorted(out)


def read_files(spark: SparkSession, root: str, exts: list[str] | None = None, ignore: list[str] | None = None, use_git: bool | None = None, store_dirs: tuple[str, ...] = STORE_DIRS) -> DataFrame:
    """The files table of a tree: id, path, ext, size, mtime, content.

    exts are the extensions to read, all known ones if not given; an empty list reads every file. The driver lists names, with git where it decides them, and never enters skipped folders; executors read the
    contents of the listed files only. Files over 4 MiB and files that cannot be read are left out; bytes that are no
    UTF-8 become replacement characters. Ids follow path order.
    """
    root = os.path.abspath(root)
    listed = git_paths(root) if (use_git if use_git is not None else is_git_repo(root)) else walked_paths(root, SKIP_DIRS + store_dirs)
    rows = spark.createDataFrame([(p,) for p in listed], "path string")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = rows.withColumn("ext", ext)
    exts = list(EXTENSIONS) if exts is None else exts
    if exts:
        rows = rows.where(F.col("ext").isin([e.lower() for e in exts]))
    if ignore:
        rows = rows.where(~paths.ignored(F.col("path"), ignore))

    def read(batches):
        for pdf in batches:
            out = []
            for path, kind in zip(pdf.path, pdf.ext):
                try:
                    at = os.path.join(root, path)
                    seen = os.stat(at)
                    if seen.st_size > MAX_BYTES:
                        continue
                    with open(at, "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                out.append((path, kind, len(content), int(seen.st_mtime), content.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "ext", "size", "mtime", "content"])

    width = max(1, min(len(listed) // 200, spark.sparkContext.defaultParallelism * 4))
    read_rows = rows.repartition(width).mapInPandas(read, "path string, ext string, size long, mtime long, content string")
    return number(cut(read_rows), "path")


def number(rows: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Consecutive ids from 1 in order of a column, without a single-task window: range partitions plus offsets."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("_m", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    placed = cut(placed)
    counts = {r._p: r.n for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    base, at = [], 1
    for p in sorted(counts):
        base.append((p, at))
        at += counts[p]
    offsets = spark.createDataFrame(base, "_p int, _b long")
    return placed.join(F.broadcast(offsets), "_p").select((F.col("_m") + F.col("_b")).alias(name), *rows.columns)
