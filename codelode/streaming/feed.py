"""A folder of files as a stream into the symbol table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.parse import enrich


def files_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet parts of the files table as they come."""
    return spark.readStream.schema("id long, path string, ext string, size long, mtime long, content string").parquet(path)


def enrich_to(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Parse each new file once and append its rows; call stop() on the query that is returned."""
    rows = enrich(files_stream(spark, source))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def relation_counts(spark: SparkSession, source: str) -> DataFrame:
    """Running counts of parsed rows by kind."""
    return enrich(files_stream(spark, source)).groupBy("tag", F.coalesce("kind", "relation").alias("what")).count()
