"""Queries over byte spans: which symbol a token lies in, which span holds a span, who names whom."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import spans
from codelode.plans.registry import query
from codelode.sources import views
from codelode.sources.views import NESTED, TOKENS

HELD = "WITH " + NESTED + TOKENS + """, held AS (SELECT t.file_id, t.name, t.place, arg_max(s.id, (s.start_byte, -s.end_byte, s.id)) AS symbol_id
 FROM tokens t LEFT JOIN nested s ON s.file_id = t.file_id AND s.start_byte <= t.place AND t.place < s.end_byte GROUP BY ALL)"""


@query(HELD + " SELECT file_id, place, symbol_id FROM held")
def enclosing_symbol(spark, d):
    """The innermost symbol around every identifier."""
    return spans.placed(views.lines(spark, d), views.nested(spark, d)).select("file_id", F.col("at").alias("place"), F.col("span_id").alias("symbol_id"))


@query(
    "WITH " + NESTED + """ SELECT a.id, arg_min(b.id, (b.end_byte - b.start_byte, b.id)) AS parent_id FROM nested a LEFT JOIN nested b
 ON a.file_id = b.file_id AND b.start_byte <= a.start_byte AND a.end_byte <= b.end_byte AND b.end_byte - b.start_byte > a.end_byte - a.start_byte GROUP BY a.id"""
)
def containing_span(spark, d):
    """The smallest symbol that strictly holds a symbol."""
    return spans.containing(views.nested(spark, d))


@query(
    HELD + """, firsts AS (SELECT file_id, name, min(id) AS dst FROM nested WHERE kind IN ('function', 'method', 'class', 'struct') GROUP BY 1, 2)
SELECT DISTINCT h.file_id, symbol_id AS src_symbol_id, dst AS dst_symbol_id, h.name AS dst_name, 'references' AS relation FROM held h JOIN firsts f ON f.file_id = h.file_id AND f.name = h.name WHERE symbol_id <> dst"""
)
def reference_edges(spark, d):
    """The edges of identifiers that name a symbol of their file."""
    return spans.references(spans.identifiers(views.lines(spark, d)), views.nested(spark, d))
