"""Text and byte functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Make slice_bytes callable from SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION slice_bytes(content STRING, s BIGINT, n BIGINT) RETURNS STRING RETURN "
        "make_valid_utf8(cast(substring(encode(content, 'UTF-8'), cast(greatest(coalesce(s, 0), 0) as int) + 1, "
        "cast(CASE WHEN n IS NULL THEN 2147483647 WHEN n >= 0 THEN least(n, 2147483647) "
        "WHEN greatest(coalesce(s, 0), 0) + n >= 0 THEN 0 ELSE greatest(octet_length(content) + n, 0) END as int)) as string))"
    )


def slice_bytes(content: Column, start: Column, length: Column | None = None) -> Column:
    """UTF-8 byte slice: negative start is 0, null length runs to the end, cut characters become replacements.

    A negative length ends the slice before its start (empty), or counts from the end where it reaches below 0.
    """
    at = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)).cast("int")
    if length is None:
        n = F.lit(2147483647)
    else:
        back = F.when(at + length >= 0, F.lit(0)).otherwise(F.greatest(F.octet_length(content) + length, F.lit(0)))
        n = F.when(length.isNull(), F.lit(2147483647)).when(length >= 0, F.least(length, F.lit(2147483647))).otherwise(back).cast("int")
    return F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), at + 1, n).cast("string"))


def tsv_cell(value: Column) -> Column:
    """A TSV cell: null is empty, a tab four spaces, a line end one space."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, "\t", "    "), "\r\n|\n|\r", " ")


def slugify(value: Column, default: str = "ref") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit(default)).otherwise(slug)


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def last_segment(value: Column) -> Column:
    """What follows the last point; null without one."""
    return F.when(F.contains(value, F.lit(".")), F.substring_index(value, ".", -1))


def escape_label(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, '"', "'"), "\n", " ")


def mermaid_id(value: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(value, r"[^\p{L}\p{N}]", "_"))


def trigrams(value: Column) -> Column:
    """Distinct lower-cased trigrams; texts under three characters have none."""
    # a capturing look-ahead meets every position once; substr by position would walk each text anew
    grams = F.regexp_extract_all(F.lower(value), F.lit("(?s)(?=(...))"), 1)
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))
