"""Strong components of graphs of any size: trimming, contraction of chains, colouring, and one task for what is small.

No group holds a component: nodes without a way in or out go, runs of nodes with one way in and one out become one
edge, and what is left takes colours, the smallest node that leads to each. A colour's own node and all that leads
back to it within the colour are a component; edges between colours lie in none. Only when a bounded number of
edges is left does a single task finish them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.graph import strong_components_of
from codelode.scratch import cut

FINISH, LEAST, SHARE = 1_000_000, 1000, 100  # edges one task may finish: a hundredth of all, within these bounds
TRIMS = 3  # rounds of trimming between contractions


def _ends(e: DataFrame, column: str, name: str) -> DataFrame:
    return e.select(F.col(column).alias(name)).distinct()


def _trim(e: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Edges between nodes that have ways in and out, a few rounds of it."""
    for _ in range(TRIMS):
        less = cut(e.join(_ends(e, "dst", "src"), "src", "left_semi").join(_ends(e, "src", "dst"), "dst", "left_semi").select("src", "dst"))
        n = less.count()
        if n == count:
            break
        e, count = less, n
    return e, count


def _chase(links: DataFrame, n: int) -> DataFrame:
    """(v, end, low, open) of links(v, to) that lead from inner nodes of chains: where the chain ends, by doubling.

    Chains that close on themselves stay open; low is then the smallest node of the cycle.
    """
    s = cut(links.select("v", F.col("to").alias("end"), F.least("v", "to").alias("low"), F.lit(True).alias("open")))
    for _ in range(max(1, n).bit_length() + 1):
        t = s.select(F.col("v").alias("end"), F.col("end").alias("_end"), F.col("low").alias("_low"))
        j = s.join(t, "end", "left")
        s = cut(j.select("v", F.coalesce("_end", "end").alias("end"), F.least("low", "_low").alias("low"), F.col("_end").isNotNull().alias("open")))
        if not s.where("open").take(1):
            break
    return s


def _contract(e: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(edges without inner nodes of chains, (v, before, after) of those, (id, component) of nodes in bare cycles)."""
    ways = e.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner = cut(ways.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("v"))
    n = inner.count()
    if not n:
        return e, None, None
    ahead = _chase(e.withColumnRenamed("src", "v").withColumnRenamed("dst", "to").join(inner, "v", "left_semi"), n)
    back = _chase(e.withColumnRenamed("dst", "v").withColumnRenamed("src", "to").join(inner, "v", "left_semi"), n)
    bare = ahead.where("open").select(F.col("v").alias("id"), F.col("low").alias("component"))
    runs = cut(ahead.where("NOT open").select("v", F.col("end").alias("after")).join(back.select("v", F.col("end").alias("before")), "v").select("v", "before", "after"))
    rest = e.join(inner.withColumnRenamed("v", "src"), "src", "left_anti").join(inner.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst")
    return cut(rest.unionByName(runs.select(F.col("before").alias("src"), F.col("after").alias("dst"))).where("src <> dst").distinct()), runs, bare


def _colours(e: DataFrame) -> DataFrame:
    """(id, colour): the smallest node that leads to each; labels of labels are taken as well, so rounds are few."""
    c = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
    while True:
        near = e.join(c.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
        low = cut(c.join(near, "id", "left").select("id", F.col("colour").alias("was"), F.least("colour", "near").alias("colour")))
        of = low.select(F.col("id").alias("colour"), F.col("colour").alias("next"))
        new = cut(low.join(of, "colour").select("id", "was", F.least("colour", "next").alias("colour")))
        c = new.select("id", "colour")
        if not new.where("was <> colour").take(1):
            return c


def _peel(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, component) of one component a colour, the edges within what is left of each colour)."""
    c = _colours(e)
    named = e.join(c.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(c.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst")
    same = cut(named.where("_a = _b").select("src", "dst"))
    found = cut(c.where("id = colour"))
    new = found
    while new.take(1):
        up = same.join(new.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
        new = cut(up.join(found.select("id"), "id", "left_anti"))
        found = cut(found.unionByName(new))
    gone = found.select("id")
    rest = same.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return found.withColumnRenamed("colour", "component"), cut(rest.select("src", "dst"))


def _finish(e: DataFrame) -> DataFrame:
    """(id, component) of a bounded number of edges, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(strong_components_of(list(zip(pdf.src.tolist(), pdf.dst.tolist()))).items()), columns=["id", "component"])

    return e.groupBy().applyInPandas(run, "id long, component long")


def strong_components(edges: DataFrame, finish: int | None = None) -> DataFrame:
    """(id, component, size, cyclic) of every node of edges(src, dst); component is its smallest node.

    cyclic holds for components of several nodes and for nodes with an edge to themselves. finish is the number of
    edges that one task may take, a hundredth of all (within bounds) if not given; 0 means that none may.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    n = e.count()
    if finish is None:
        finish = min(FINISH, max(LEAST, n // SHARE))
    found, chains = [], []
    while n:
        e, n = _trim(e, n)
        if n <= finish:
            break
        e, runs, bare = _contract(e)
        if runs is not None:
            chains.append(runs)
            found.append(bare)
            shorter = e.count()
            if shorter <= finish or shorter < n * 3 // 4:
                n = shorter
                continue
        one, e = _peel(e)
        found.append(one)
        n = e.count()
    if n:
        found.append(_finish(e))
    known = edges.sparkSession.createDataFrame([], "id long, component long")
    for x in found:
        known = known.unionByName(x)
    known = cut(known)
    # a node inside a chain is in the component of both its ends, or alone
    for runs in reversed(chains):
        side = lambda name: known.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
        j = runs.join(side("before"), "before", "left").join(side("after"), "after", "left")
        a, b = F.coalesce("_before", "before"), F.coalesce("_after", "after")
        inside = j.where(a == b).select(F.col("v").alias("id"), a.alias("component"))
        ends = j.where(a == b).select(F.col("before").alias("id"), a.alias("component")).join(known.select("id"), "id", "left_anti").distinct()
        known = cut(known.unionByName(inside).unionByName(ends))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    named = cut(nodes.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("_c")))
    size = named.groupBy("_c").agg(F.min("id").alias("component"), F.count("*").alias("size"))
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("_loop", F.lit(True))
    out = named.join(size, "_c").join(loops, "id", "left")
    return out.select("id", "component", "size", ((F.col("size") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))
