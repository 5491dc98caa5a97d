"""Reading workspaces: manifests of selected files and pruned copies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import paths, text
from codelode.operators import rules

STATUSES = ("active", "shelved", "cleared")


def manifest(task: str, date: str, source: str) -> dict:
    slug = re.sub(r"[^a-z0-9]+", "-", task.lower()).strip("-") or "ref"
    return {"id": f"{date}-{slug}", "task": task, "date": date, "source_project": source, "status": "active", "worktree": None, "files": [], "annotations": [], "sub_index": None}


def with_status(doc: dict, status: str) -> dict:
    if status not in STATUSES:
        raise ValueError(f"status {status!r} is unknown")
    return {**doc, "status": status}


def select(result: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a query result that has a path column, each once, with a unique copy name.

    The base name serves where it is free; else the parent folders' slug goes in front, then a counter.
    """
    if "path" not in result.columns:
        raise ValueError("the query returns no path column")
    chosen = files.join(result.select("path").distinct(), "path", "left_semi")
    base, parent = paths.base_name(F.col("path")), text.slugify(paths.parent_dir(F.col("path"), "root"))
    named = chosen.withColumn("_b", base).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("path")))
    named = named.withColumn("_c", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat(parent, F.lit("-"), "_b")))
    named = named.withColumn("_k", F.row_number().over(Window.partitionBy("_c").orderBy("path")))
    copy = F.when(F.col("_k") == 1, F.col("_c")).otherwise(F.concat((F.col("_k")).cast("string"), F.lit("-"), "_c"))
    return named.withColumn("copy", copy).drop("_b", "_n", "_c", "_k")


def prune(files: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """(id, content): contents without the conditional spans that name no kept macro."""
    lines = files.select(F.col("id").alias("file_id"), F.posexplode(F.split("content", "\n")).alias("p", "line"))
    lines = lines.select("file_id", (F.col("p") + 1).alias("line_no"), "line")
    left = rules.prune_ifdef(lines, spans, keep)
    out = left.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = out.select(F.col("file_id").alias("id"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))
    return files.select("id").join(joined, "id", "left").fillna("", ["content"])
