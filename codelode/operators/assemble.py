"""From the rows a parser emits to the symbols and edges tables: ids, parents and endpoints, as joins within a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators import parse
from codelode.scratch import cut
from codelode.sources.store import Store, upsert_meta

SPAN = 1 << 24  # ids of a file; more symbols or edges in one file are an error
DSL = ("matlang", "bplisp", "animlang")
TYPES = ("class", "struct", "interface")


def _id(number):
    inside = F.assert_true(number < SPAN, F.lit("a file has more rows than ids"))
    return F.when(inside.isNull(), F.col("file_id") * SPAN + number)


def symbols(rows: DataFrame) -> DataFrame:
    """rows(file_id, local, parent_local, ...) with id and parent_id; a parent that a rule has dropped is no parent."""
    names = [c for c in rows.columns if c not in ("local", "parent_local")]
    up = rows.select("file_id", F.col("local").alias("parent_local")).distinct()
    known = rows.join(up.withColumn("_p", F.lit(True)), ["file_id", "parent_local"], "left")
    parent = F.when(F.col("_p"), _id(F.col("parent_local")))
    return known.select(_id(F.col("local")).alias("id"), *names, parent.alias("parent_id"))


def edges(rows: DataFrame, symbol_rows: DataFrame, dsl: tuple[str, ...] = DSL) -> DataFrame:
    """edges(id, file_id, src_symbol_id, dst_symbol_id, dst_name, relation) of rows(file_id, src_local, dst_local, dst_name, relation).

    A target by place is that symbol; a target by name is the first type of the name in the file, or the first
    symbol of any kind in the S-expression languages; else it stays null, to be resolved by name over all files.
    An edge goes if its source or its target by place was dropped by a rule.
    """
    here = symbol_rows.select("file_id", "local").distinct()
    alive = rows.join(here.withColumnRenamed("local", "src_local"), ["file_id", "src_local"], "left_semi")
    placed = alive.join(here.select("file_id", F.col("local").alias("dst_local"), F.lit(True).alias("_there")), ["file_id", "dst_local"], "left")
    placed = placed.where("dst_local IS NULL OR _there")
    named = symbol_rows.where(F.col("lang").isin(*dsl) | F.col("kind").isin(*TYPES)).groupBy("file_id", F.col("name").alias("dst_name")).agg(F.min("local").alias("_first"))
    j = placed.join(named, ["file_id", "dst_name"], "left")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("src_local", "relation", "dst_name", "dst_local"))
    target = F.coalesce(F.col("dst_local"), F.col("_first"))
    return j.select(_id(number).alias("id"), "file_id", _id(F.col("src_local")).alias("src_symbol_id"), F.when(target.isNotNull(), _id(target)).alias("dst_symbol_id"), "dst_name", "relation")


def enrich_store(store: Store, apply_rules=None, langs: list[str] | None = None) -> DataFrame:
    """Parse the files of a store, all or those of some languages, let rules change the symbols, and write symbols and edges. Returns the error rows.

    apply_rules takes and gives symbol rows (with path). Tables are replaced as a whole, so a run can be repeated.
    """
    rows = cut(parse.enrich(store.table("files"), langs))  # files are parsed once
    made = rows.where("tag = 'symbol'").select("file_id", "local", "name", "kind", "lang", "start_line", "end_line", "start_byte", "end_byte", "parent_local")
    made = made.withColumn("attrs", F.lit(None).cast("map<string,string>")).withColumn("provenance", F.lit(None).cast("array<string>"))
    if apply_rules:
        paths = store.table("files").select(F.col("id").alias("file_id"), "path")
        made = apply_rules(made.join(paths, "file_id")).drop("path")
    found = rows.where("tag = 'edge'").select("file_id", "src_local", "dst_local", "dst_name", "relation")
    store.write("symbols", symbols(made))
    store.write("edges", edges(found, made))
    spark = rows.sparkSession
    counts = [(f"enrich.{k}", str(store.table(k).count())) for k in ("symbols", "edges")]
    store.write("meta", spark.createDataFrame(upsert_meta(store.table("meta"), spark.createDataFrame(counts, "key string, value string")).collect(), "key string, value string"))  # a few keys
    return rows.where("tag = 'error'").select("file_id", "error")
