"""The query log: latest notes, staleness, preflight, search and the life of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_latest_note(log: DataFrame, notes: DataFrame) -> DataFrame:
    """Log rows with the note of the largest id, if any."""
    last = notes.groupBy(F.col("log_id").alias("_l")).agg(F.max_by(F.struct("note", "tag", "status"), "id").alias("_n"))
    return log.join(last, log.id == F.col("_l"), "left").select(*log.columns, F.col("_n.note").alias("note"), F.col("_n.tag").alias("tag"), F.col("_n.status").alias("status"))


def view(log: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per log row and note."""
    n = notes.select(F.col("log_id").alias("_l"), F.col("note"), F.col("tag"), F.col("status"))
    return log.join(n, log.id == F.col("_l"), "left").drop("_l")


def matches(terms: list[str]) -> Column:
    """All terms, case-insensitive, in statement, task tag, tag and note."""
    blob = F.lower(F.concat_ws(" ", "sql_text", "task_tag", "tag", "note"))
    cond = F.lit(True)
    for t in terms:
        cond = cond & F.contains(blob, F.lit(t.lower()))
    return cond


def stale(log: DataFrame, today: str, max_days: int, state: DataFrame | None = None) -> DataFrame:
    """log with stale and reason. Dynamic rows are stale by age, else by the first file that went or changed.

    state: files(path, mtime, size) as they are; log.file_state array<struct<path,mtime,size>>. A date that does
    not parse means no age check.
    """
    age = F.datediff(F.to_date(F.lit(today)), F.try_to_date("valid_date") if log.schema["valid_date"].dataType.simpleString() == "string" else F.col("valid_date"))
    old = F.when((F.col("kind") == "dynamic") & (age > max_days), F.concat(F.lit("age "), age.cast("string"), F.lit("d")))
    if state is None or "file_state" not in log.columns:
        return log.withColumn("reason", old).withColumn("stale", F.col("reason").isNotNull())
    f = log.where("kind = 'dynamic'").select("id", F.posexplode("file_state").alias("pos", "was"))
    now = state.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    j = f.join(now, f.was.path == F.col("_p"), "left")
    why = F.when(F.col("_p").isNull(), F.concat(F.lit("missing "), "was.path")).when(F.col("_m") != F.col("was.mtime"), F.concat(F.lit("mtime changed "), "was.path")).when(F.col("_s") != F.col("was.size"), F.concat(F.lit("size changed "), "was.path"))
    first = j.select("id", "pos", why.alias("why")).where("why IS NOT NULL").groupBy("id").agg(F.min_by("why", "pos").alias("why"))
    out = log.join(first, "id", "left").withColumn("reason", F.coalesce(old, "why")).drop("why")
    return out.withColumn("stale", F.col("reason").isNotNull())


def preflight(log: DataFrame, notes: DataFrame, today: str, max_days: int = 30, terms: list[str] = (), limit: int = 12) -> DataFrame:
    """Two sections, newest first: static or noted rows, and other dynamic rows with their staleness."""
    rows = with_latest_note(log, notes).where("status IS NULL OR status = 'active'").where(matches(list(terms)))
    rows = stale(rows, today, max_days).withColumn("section", F.when((F.col("kind") == "static") | F.col("note").isNotNull(), 1).otherwise(2))
    w = Window.partitionBy("section").orderBy(F.desc("ts"), F.desc("id"))
    # the first rows of a section are kept within each partition before the window ranks them
    top = [rows.where(F.col("section") == k).orderBy(F.desc("ts"), F.desc("id")).limit(limit) for k in (1, 2)]
    return top[0].unionByName(top[1]).withColumn("rank", F.row_number().over(w))


def set_status(notes: DataFrame, log_ids: list[int], status: str, now: int) -> DataFrame:
    """Notes with the latest of each log row set to a status; rows without one get a new note."""
    spark = notes.sparkSession
    wanted = spark.createDataFrame([(i,) for i in log_ids], "log_id long")
    last = notes.groupBy("log_id").agg(F.max("id").alias("_last"))
    j = notes.join(wanted.join(last, "log_id").select(F.col("_last").alias("id")).withColumn("_set", F.lit(True)), "id", "left")
    changed = j.withColumn("status", F.when(F.col("_set"), F.lit(status)).otherwise(F.col("status"))).select(notes.columns)
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = wanted.join(notes, "log_id", "left_anti").orderBy("log_id").collect()
    rows = [(top + k + 1, r.log_id, "", "", status, now) for k, r in enumerate(fresh)]
    return changed.unionByName(spark.createDataFrame(rows, notes.schema)) if rows else changed


def tag(notes: DataFrame, log_id: int, note: str, tag_: str, now: int) -> DataFrame:
    """Notes with one more, active."""
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return notes.unionByName(notes.sparkSession.createDataFrame([(top + 1, log_id, note, tag_, "active", now)], notes.schema))


def append(log: DataFrame, project: str, db_path: str, sql: str, kind: str, task_tag: str | None, now: int, today: str | None, state: list | None) -> DataFrame:
    """The log with one more row; static rows carry no date and no state."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    dynamic = kind == "dynamic"
    row = (top + 1, now, project, db_path, sql, kind, task_tag, today if dynamic else None, state if dynamic else None)
    return log.unionByName(log.sparkSession.createDataFrame([row], log.schema))
