"""Graph operators on edge tables (src, dst[, relation, weight])."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import paths
from codelode.scratch import cut
from codelode.sources.tree import number


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Weights summed per (src, dst, relation)."""
    return edges.groupBy("src", "dst", "relation").agg(F.sum("weight").alias("weight"))


def rollup(edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, edges between groups) for groups(id, grp); edges within a group go."""
    a, b = groups.select(F.col("id").alias("src"), F.col("grp").alias("gs")), groups.select(F.col("id").alias("dst"), F.col("grp").alias("gd"))
    between = edges.join(a, "src").join(b, "dst").where("gs <> gd").groupBy("gs", "gd", "relation").agg(F.sum("weight").alias("weight"))
    return groups.groupBy("grp").agg(F.count("*").alias("members")), between


def rollup_frontier(groups: DataFrame, frontier: DataFrame) -> DataFrame:
    """(grp, members, frontier): the counts of frontier(id, n), what a bounded slice left out, added up by group."""
    return groups.join(frontier, "id", "left").groupBy("grp").agg(F.count("*").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("frontier"))


def module_groups(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, grp) of nodes(id, path): the nearest folder above with a build marker, (root) for one at the root, else the first segment.

    A path meets the folders by its own prefixes, so the join is on equality.
    """
    clean = F.translate(F.coalesce("path", F.lit("")), "\\", "/")
    roots = files.where(paths.is_build_marker(F.col("path"))).select(paths.parent_dir(F.translate("path", "\\", "/"), "").alias("root")).distinct()
    parts = F.split(clean, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    near = nodes.select("id", F.explode(F.array_distinct(above)).alias("root")).join(roots, "root").groupBy("id").agg(F.max_by("root", F.length("root")).alias("root"))
    first = F.substring_index(clean, "/", 1)
    group = F.when(F.col("root") == "", "(root)").when(F.col("root").isNotNull(), F.col("root")).when(first == "", "(root)").otherwise(first)
    return nodes.join(near, "id", "left").select("id", group.alias("grp"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct non-self predecessors and successors, and instability to three digits (0 when isolated)."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ca = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ca"))
    ce = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ce"))
    j = nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").fillna(0, ["ca", "ce"])
    return j.select("id", "ca", "ce", F.coalesce(F.round(F.try_divide("ce", F.col("ca") + F.col("ce")), 3), F.lit(0.0)).alias("instability"))


@dataclass
class Slice:
    """A bounded slice: nodes(id, depth), edges(src, dst), frontier(id, n) and the accounting of what was left out."""

    nodes: DataFrame
    edges: DataFrame
    frontier: DataFrame
    truncated: bool
    depth_bounded: bool
    frontier_depth: int
    elided: int


def bfs_bounded(edges: DataFrame, seeds: DataFrame, max_nodes: int = 200, max_depth: int = 3, direction: str = "out") -> Slice:
    """Breadth-first slice that takes whole levels: a level that does not fit is refused as one.

    Each level is one join with the edges and one anti-join with the nodes taken, then a checkpoint, so lineage
    stays flat; the nodes taken never exceed the budget. Seeds over the budget are cut in id order.
    """
    step = edges.select("src", "dst").distinct()
    if direction == "in":
        step = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    got = expand(lambda level: step.join(F.broadcast(level.withColumnRenamed("id", "src")), "src"), seeds, max_nodes, max_depth)  # at most max_nodes rows
    if direction == "in":
        got.edges = got.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return got


def expand(step, seeds: DataFrame, max_nodes: int = 200, max_depth: int = 3) -> Slice:
    """The slice around seeds(id) that step leads to; step(level) gives edges from the ids of a level, with columns src, dst and more.

    A level has at most max_nodes rows, so a step may broadcast it. Steps see each level once.
    """
    spark = seeds.sparkSession
    wanted = seeds.select("id").distinct()
    n_seeds = wanted.count()
    taken = cut(wanted.orderBy("id").limit(max_nodes).withColumn("depth", F.lit(0)))
    total, truncated, elided, depth = min(n_seeds, max_nodes), n_seeds > max_nodes, max(0, n_seeds - max_nodes), 0
    frontier = spark.createDataFrame([], "id " + seeds.schema["id"].dataType.simpleString() + ", n long")
    seen, bounded = None, False
    while True:
        out = step(taken.where(F.col("depth") == depth).select("id"))
        seen = out.where(F.lit(False)) if seen is None else seen
        fresh = out.select("src", "dst").join(taken.select(F.col("id").alias("dst")), "dst", "left_anti")
        new = fresh.select("dst").distinct()
        count = new.limit(max_nodes - total + 1).count()
        if not count:
            seen = seen.unionByName(out)
            break
        if depth == max_depth or total + count > max_nodes:
            over = depth < max_depth
            truncated, bounded = truncated or over, not over
            if over:
                seen = seen.unionByName(out.join(taken.select(F.col("id").alias("dst")), "dst", "left_semi").select(*out.columns))
            frontier = fresh.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
            elided += new.count() if over else 0
            break
        seen = seen.unionByName(out)
        depth += 1
        taken = cut(taken.unionByName(new.select(F.col("dst").alias("id"), F.lit(depth).alias("depth"))))
        total += count
    return Slice(taken, seen.distinct(), frontier, truncated, bounded, depth, elided)


def shorten(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """edges(src, dst, w) with every chain as one edge as long as it, and (v, before, off) of the nodes inside chains.

    Inside are nodes with one edge in and one out. Their chains are followed both ways at once by doubling, so rounds
    go with the logarithm of the longest chain. Of parallel edges the longest stays. Chains closed on themselves go.
    """
    ways = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner = cut(ways.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("v"))
    n = inner.count()
    if not n:
        return edges, None
    ahead = edges.select(F.col("src").alias("v"), F.col("dst").alias("after"), F.col("w").alias("fore"))
    back = edges.select(F.col("dst").alias("v"), F.col("src").alias("before"), F.col("w").alias("off"))
    s = cut(inner.join(ahead, "v").join(back, "v"))
    for _ in range(n.bit_length() + 1):
        a = s.select(F.col("v").alias("after"), F.col("after").alias("_after"), F.col("fore").alias("_fore"))
        b = s.select(F.col("v").alias("before"), F.col("before").alias("_before"), F.col("off").alias("_off"))
        j = s.join(a, "after", "left").join(b, "before", "left")
        s = cut(j.select("v", F.coalesce("_after", "after").alias("after"), (F.col("fore") + F.coalesce("_fore", F.lit(0))).alias("fore"), F.coalesce("_before", "before").alias("before"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), (F.col("_after").isNotNull() | F.col("_before").isNotNull()).alias("open")))
        if not s.where("open").take(1):
            break
    runs = s.where("NOT open").select("v", "before", "off", "after", (F.col("off") + F.col("fore")).alias("w"))
    rest = edges.join(inner.withColumnRenamed("v", "src"), "src", "left_anti").join(inner.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "w")
    whole = rest.unionByName(runs.select(F.col("before").alias("src"), F.col("after").alias("dst"), "w"))
    return cut(whole.groupBy("src", "dst").agg(F.max("w").alias("w"))), runs.select("v", "before", "off")


def layers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, layer), the longest way from a node without predecessors, and the nodes in or behind a cycle.

    Chains are shortened to one edge as long as they, again while that takes a good part of the edges; then nodes
    without predecessors are peeled round by round, so rounds follow the branches on a way and not its length.
    """
    first = cut(edges.where("src <> dst").select("src", "dst", F.lit(1).cast("long").alias("w")).distinct())
    nodes = cut(first.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    e, chains, size = first, [], first.count()
    while size:
        e, runs = shorten(e)
        if runs is None:
            break
        chains.append(runs)
        size, was = e.count(), size
        if size > was * 3 // 4:
            break
    # an edge from a node to itself stands for a cycle of chains and is never peeled
    left = nodes
    for runs in chains:
        left = left.join(runs.select(F.col("v").alias("id")), "id", "left_anti")
    left = cut(left.join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")).withColumn("layer", F.lit(0).cast("long"))
    done = None
    while True:
        now = cut(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if not now.take(1):
            break
        done = now if done is None else done.unionByName(now)
        gone = now.select(F.col("id").alias("src"), "layer")
        met = e.join(gone, "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("layer") + F.col("w")).alias("_at"))
        rest = left.join(now.select("id"), "id", "left_anti").join(met, "id", "left")
        left = cut(rest.select("id", F.greatest("layer", F.coalesce("_at", "layer")).alias("layer")))
        e = cut(e.join(gone.select("src"), "src", "left_anti"))
    done = left.where(F.lit(False)) if done is None else cut(done)
    for runs in reversed(chains):
        at = done.select(F.col("id").alias("before"), F.col("layer").alias("_at"))
        done = cut(done.unionByName(runs.join(at, "before").select(F.col("v").alias("id"), (F.col("_at") + F.col("off")).alias("layer"))))
    return done.select("id", F.col("layer").cast("int").alias("layer")), nodes.join(done.select("id"), "id", "left_anti")


def topological_order(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, place from 1), and the nodes in or behind a cycle; edges from a node to itself do not count.

    Nodes without predecessors come first by id; every other node follows its last predecessor, nodes of the same
    last predecessor by id. That order never mixes layers, so it is made a layer at a time.
    """
    placed, left = layers(edges)
    placed = cut(placed)
    deepest = placed.agg(F.max("layer")).first()[0]
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    out, met = None, 0
    for k in range(0 if deepest is None else deepest + 1):
        now = placed.where(F.col("layer") == k).select("id")
        if out is None:
            now = now.withColumn("_after", F.lit(0).cast("long"))
        else:
            last = pairs.join(out.select(F.col("id").alias("src"), "place"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("place").alias("_after"))
            now = now.join(last, "id")
        now = cut(number(now.withColumn("_key", F.struct("_after", "id")), "_key", "place").select("id", (F.col("place") + met).cast("long").alias("place")))
        met += now.count()
        out = now if out is None else out.unionByName(now)
    return (placed.select("id", F.lit(0).cast("long").alias("place")) if out is None else out), left


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that seeds(id) reach, themselves included."""
    step = edges.select("src", "dst").distinct()
    seen = cut(seeds.select("id").distinct())
    new = seen
    while True:
        out = step.join(new.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        new = cut(out.join(seen, "id", "left_anti"))
        if not new.take(1):
            return seen
        seen = cut(seen.unionByName(new))


BUNDLE = 50_000  # edges of the slices that one call takes together


class SliceTooLarge(ValueError):
    """A slice has more edges than one task may take."""


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that each node is joined to, direction aside.

    Each round takes the least label of the neighbours and then the label of that label, so the rounds follow the
    logarithm of a component's extent rather than the extent; nothing is collected.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(both.where("src <> dst").distinct())
    names = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    label = cut(names.withColumn("component", F.col("id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("least"))
        low = label.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "least").alias("at"))
        # a node that is a label takes the least its holders have seen, then every node takes the label of its label
        seen = low.groupBy(F.col("was").alias("id")).agg(F.min("at").alias("to"))
        low = cut(low.join(seen, "id", "left").select("id", "was", F.least("at", F.coalesce("to", "at")).alias("at")))
        low = low.join(low.select(F.col("id").alias("root"), F.col("at").alias("next")), F.col("at") == F.col("root")).select("id", "was", F.col("next").alias("at"))
        new = cut(low)
        label = new.select("id", F.col("at").alias("component"))
        if not new.where("was <> at").take(1):
            return label


def slices(edges: DataFrame, budget: int = 1_000_000) -> DataFrame:
    """edges(src, dst) with the slice each belongs to, its weak component; SliceTooLarge if one has over budget edges."""
    comp = weak_components(edges).select(F.col("id").alias("src"), F.col("component").alias("slice"))
    out = edges.select("src", "dst").join(comp, "src").select("slice", "src", "dst")
    return within_budget(out, budget)


def within_budget(edges: DataFrame, budget: int) -> DataFrame:
    """edges(slice, ...) as they are, if no slice has over budget of them."""
    most = edges.groupBy("slice").count().agg(F.max("count")).first()[0]
    if most is not None and most > budget:
        raise SliceTooLarge(f"a slice has {most} edges, over the budget of {budget}")
    return edges


def strong_components_of(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Node to the smallest node of its strong component (iterative path-based search)."""
    succ: dict[int, list[int]] = {}
    for a, b in pairs:
        succ.setdefault(a, []).append(b)
        succ.setdefault(b, [])
    index: dict[int, int] = {}
    out: dict[int, int] = {}
    path: list[int] = []
    place: dict[int, int] = {}
    bound: list[int] = []
    for root in succ:
        if root in index:
            continue
        work = [(root, iter(succ[root]))]
        index[root] = len(index)
        place[root] = len(path)
        path.append(root)
        bound.append(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = len(index)
                    place[nxt] = len(path)
                    path.append(nxt)
                    bound.append(nxt)
                    work.append((nxt, iter(succ[nxt])))
                    break
                if nxt not in out:
                    while index[bound[-1]] > index[nxt]:
                        bound.pop()
            else:
                work.pop()
                if bound[-1] == node:
                    bound.pop()
                    at = place[node]
                    comp = path[at:]
                    del path[at:]
                    out.update(dict.fromkeys(comp, min(comp)))
    return out


def weak_points(pairs: list[tuple[int, int]]) -> tuple[set[tuple[int, int]], set[int]]:
    """(bridges, cut nodes) of the undirected graph by low points in one pass; parallel edges are no bridges."""
    many: dict[tuple[int, int], int] = {}
    adj: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            key = (min(a, b), max(a, b))
            many[key] = many.get(key, 0) + 1
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges, cuts = set(), set()
    for root in adj:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        work, kids = [(root, None, iter(adj[root]))], 0
        while work:
            node, up, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    work.append((nxt, node, iter(adj[nxt])))
                    break
                if nxt != up:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if up is None:
                    continue
                low[up] = min(low[up], low[node])
                if low[node] > order[up] and many[min(up, node), max(up, node)] == 1:
                    bridges.add((min(up, node), max(up, node)))
                if up == root:
                    kids += 1
                elif low[node] >= order[up]:
                    cuts.add(up)
        if kids > 1:
            cuts.add(root)
    return bridges, cuts


def strong_components(edges: DataFrame) -> DataFrame:
    """(slice, id, component, size, cyclic) for edges(slice, src, dst); a slice is bounded by its budget and lies in one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, pairs in by_slice(pdf):
            comp = strong_components_of(pairs)
            size, loops = Counter(comp.values()), {a for a, b in pairs if a == b}
            rows += [(s, n, c, size[c], size[c] > 1 or n in loops) for n, c in comp.items()]
        return pd.DataFrame(rows, columns=["slice", "id", "component", "size", "cyclic"]).astype({c: "int64" for c in ("slice", "id", "component", "size")} | {"cyclic": "bool"})

    return bundled(edges.select("slice", "src", "dst").distinct(), run, "slice long, id long, component long, size long, cyclic boolean")


def bundled(edges: DataFrame, run, schema: str, size: int = BUNDLE) -> DataFrame:
    """run(pdf) over edges(slice, src, dst) in groups of whole slices, size edges or so each: slices are often tiny, and a group costs its start."""
    rows = edges.select("slice", "src", "dst")
    n = rows.count() // size + 1
    return rows.groupBy(F.pmod(F.xxhash64("slice"), F.lit(n)).alias("_bundle")).applyInPandas(run, schema)


def bridges(edges: DataFrame) -> DataFrame:
    """(slice, a, b): undirected edges whose removal splits a component, for edges(slice, src, dst)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, *pair) for s, pairs in by_slice(pdf) for pair in sorted(weak_points(pairs)[0])]
        return pd.DataFrame(rows, columns=["slice", "a", "b"]).astype("int64")

    return bundled(edges, run, "slice long, a long, b long")


def cut_nodes(edges: DataFrame) -> DataFrame:
    """(slice, id): nodes whose removal splits a component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, n) for s, pairs in by_slice(pdf) for n in sorted(weak_points(pairs)[1])]
        return pd.DataFrame(rows, columns=["slice", "id"]).astype("int64")

    return bundled(edges, run, "slice long, id long")


def by_slice(pdf: pd.DataFrame) -> list[tuple[int, list[tuple[int, int]]]]:
    """The edges of each slice of a bundle, slices in order."""
    found: dict[int, list[tuple[int, int]]] = {}
    for s, a, b in zip(pdf.slice.tolist(), pdf.src.tolist(), pdf.dst.tolist()):
        found.setdefault(s, []).append((a, b))
    return sorted(found.items())


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    keep = nodes.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def hubs(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(id, deg, fan_in, fan_out, hub): hubs are cut nodes or nodes at or over the 90th nearest-rank fan-in (at least 2)."""
    c = coupling(nodes, edges).select("id", F.col("ca").alias("fan_in"), F.col("ce").alias("fan_out"))
    # the nearest rank from the counts of each fan-in: as many rows as there are distinct fan-ins
    sizes = c.groupBy("fan_in").agg(F.count("*").alias("k"))
    below = Window.orderBy("fan_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.select("fan_in", F.sum("k").over(below).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("n"))
    at = F.least(F.floor(F.col("n") * 90 / 100), F.col("n") - 1)
    gate = ranked.where(F.col("upto") > at).agg(F.greatest(F.lit(2), F.min("fan_in")).alias("gate"))
    marked = c.crossJoin(F.broadcast(gate)).join(cuts.select("id").withColumn("cut", F.lit(True)), "id", "left")  # one row
    return marked.select("id", (F.col("fan_in") + F.col("fan_out")).alias("deg"), "fan_in", "fan_out", (F.coalesce("cut", F.lit(False)) | (F.col("fan_in") >= F.col("gate"))).alias("hub"))


def metrics(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, cycles, and the labels of the most unstable and the most depended on of nodes(id, label).

    Nodes are ranked by instability, fan-out and id; the most depended on is the first of that rank with the largest fan-in.
    """
    c = coupling(nodes, edges).join(nodes.select("id", "label"), "id")
    unstable = F.min_by("label", F.struct(-F.col("instability"), -F.col("ce"), F.col("id")))
    wanted = F.min_by("label", F.struct(-F.col("ca"), -F.col("instability"), -F.col("ce"), F.col("id")))
    head = c.agg(F.count("*").alias("nodes"), unstable.alias("most_unstable"), wanted.alias("most_depended_on"))
    cycles = components.where("cyclic").agg(F.countDistinct("component").alias("cycles"))
    return head.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(cycles).select("nodes", "edges", "cycles", "most_unstable", "most_depended_on")  # three single rows
