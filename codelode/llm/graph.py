"""Connected components on the cluster, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import remove, table


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of edges(src, dst), component = its smallest reachable node.

    Alternating large-star and small-star steps until the edge set is a star forest. Each step aggregates
    with map-side partials and joins on shuffled keys, so a hub is split by AQE's skew join; each round is
    written to the shared scratch folder. Self-links, nulls and repeated links are ignored; no links give no rows.
    """
    spark = edges.sparkSession
    cur, path = table(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        label,
    )
    mark = None
    while True:
        both = cur.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(cur.select(F.col("v").alias("a"), F.col("u").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = cur.join(near, "v").select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        remove(spark, path)
        cur, path = new, new_path
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
