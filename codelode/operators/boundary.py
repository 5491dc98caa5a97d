"""Target and dependency zones, N-way modules, and the views between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import paths


def zones(nodes: DataFrame, root: str) -> DataFrame:
    """nodes(id, path) with zone target or dependency."""
    return nodes.withColumn("zone", F.when(paths.in_zone(F.col("path"), root), "target").otherwise("dependency"))


def classify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the zone of either end (null for unknown ends) and whether they cross."""
    a = nodes.select(F.col("id").alias("src"), F.col("zone").alias("src_zone"))
    b = nodes.select(F.col("id").alias("dst"), F.col("zone").alias("dst_zone"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("cross", ~F.coalesce(F.col("src_zone") == F.col("dst_zone"), F.lit(False)))


def crossings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from target to dependency."""
    return classify(edges, nodes).where("src_zone = 'target' AND coalesce(dst_zone, 'dependency') = 'dependency'")


def boundary_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Target nodes with an edge into the dependency."""
    return nodes.where("zone = 'target'").join(crossings(edges, nodes).select(F.col("src").alias("id")), "id", "left_semi")


def internal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges within the target."""
    return classify(edges, nodes).where("src_zone = 'target' AND dst_zone = 'target'")


def surface(edges: DataFrame, nodes: DataFrame, module: Column) -> DataFrame:
    """Crossing edges with dependency nodes folded into their module: (src, module, edges, weight)."""
    named = nodes.select(F.col("id").alias("dst"), module.alias("module"))
    return crossings(edges, nodes).join(named, "dst").groupBy("src", "module").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def bands(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with band 0 target core, 1 target at the boundary, 2 dependency at the boundary, 3 other dependency."""
    x = crossings(edges, nodes).select("src", "dst")
    a, b = x.select(F.col("src").alias("id")).distinct().withColumn("_o", F.lit(1)), x.select(F.col("dst").alias("id")).distinct().withColumn("_i", F.lit(1))
    j = nodes.join(a, "id", "left").join(b, "id", "left")
    band = F.when((F.col("zone") == "target") & F.col("_o").isNull(), 0).when(F.col("zone") == "target", 1).when(F.col("_i").isNotNull(), 2).otherwise(3)
    return j.select(*nodes.columns, band.alias("band"))


def module_spec(document: list[dict], inline: list[str] = ()) -> list[dict]:
    """Zones of a document and of NAME=P[,P] items; the same name appends. Order is the order of declaration."""
    spec: dict[str, dict] = {}
    for z in document:
        own = spec.setdefault(z["name"], {"name": z["name"], "include": [], "exclude": []})
        own["include"] += z.get("include", [])
        own["exclude"] += z.get("exclude", [])
    for item in inline:
        name, _, prefixes = item.partition("=")
        if not name or not prefixes:
            raise ValueError(f"NAME=P[,P] is wanted, not {item!r}")
        spec.setdefault(name, {"name": name, "include": [], "exclude": []})["include"] += [p for p in prefixes.split(",") if p]
    return list(spec.values())


def modules(files: DataFrame, spec: list[dict], fallback: str = "External") -> DataFrame:
    """files(path, ...) with module and prefix: the longest include prefix, then prefix, then declaration; else fallback.

    The spec is driver-side and small; the test of a path is one expression without a join.
    """
    norm = lambda p: re.sub(r"^[./]+", "", p.replace("\\", "/")).rstrip("/")
    rules = sorted(((norm(p), k, z["name"], z.get("exclude", [])) for k, z in enumerate(spec) for p in z["include"]), key=lambda r: (-len(r[0]), r[0], r[1]))
    path = paths.normalise(F.col("path"))
    module, prefix = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for p, _, name, exclude in rules:
        hit = F.lit(True) if p == "" else (path == p) | path.startswith(p + "/")
        for x in exclude:
            out = path.rlike(paths.glob_regex(x)) if any(c in x for c in "*?[") else (path == norm(x)) | path.startswith(norm(x) + "/")
            hit = hit & ~out
        module, prefix = module.when(hit, F.lit(name)), prefix.when(hit, F.lit(p))
    return files.withColumn("module", F.coalesce(module, F.lit(fallback))).withColumn("prefix", prefix)


def round_robin(seeds: DataFrame, cap: int) -> DataFrame:
    """The first cap rows of each zone by path and id, dealt out one zone after the other: seeds(zone, decl, path, id)."""
    w = Window.partitionBy("zone").orderBy("path", "id")
    return seeds.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).orderBy("rn", "decl")


def seed_budget(max_nodes: int, n_zones: int) -> tuple[int, int]:
    """(nodes for seeds, seeds a zone): three fifths of the budget, and at least one a zone."""
    total = max(n_zones, max_nodes * 3 // 5)
    return total, max(1, total // max(1, n_zones))


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), F.col("module").alias("sm"))
    b = nodes.select(F.col("id").alias("dst"), F.col("module").alias("dm"))
    return edges.join(a, "src").join(b, "dst")


def matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sm, dm, edge_count, weight, n_src, n_dst) for every pair of modules with edges, the diagonal included."""
    return _ends(edges, nodes).groupBy("sm", "dm").agg(F.count("*").alias("edge_count"), F.sum("weight").alias("weight"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def matrix_by_relation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _ends(edges, nodes).groupBy("sm", "dm", "relation").agg(F.count("*").alias("edge_count"))


def needed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sm, dm, dst, label, relations, ref_count): what a module needs of another."""
    e = _ends(edges, nodes).where("sm <> dm").groupBy("sm", "dm", "dst").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.countDistinct("src").alias("ref_count"))
    return e.join(nodes.select(F.col("id").alias("dst"), "label"), "dst")


def cut_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sm, dm, cost, edge_count): needed symbols and edges of each pair, cheapest first."""
    e = _ends(edges, nodes).where("sm <> dm")
    return e.groupBy("sm", "dm").agg(F.countDistinct("dst").alias("cost"), F.count("*").alias("edge_count")).orderBy("cost", "sm", "dm")


def fan_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out, instability) in edges between modules, instability to four digits."""
    e = _ends(edges, nodes).where("sm <> dm")
    both = e.select(F.col("sm").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dm").alias("module"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    s = both.groupBy("module").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    s = nodes.select("module").distinct().join(s, "module", "left").fillna(0, ["fan_in", "fan_out"])
    return s.withColumn("instability", F.coalesce(F.round(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), 4), F.lit(0.0)))


def hidden(nodes: DataFrame, names: list[str] = (), patterns: list[str] = (), min_fan_in: int | None = None) -> DataFrame:
    """Dependency nodes to hide by label, last :: segment, pattern or fan-in: nodes(id, label, zone, fan_in)."""
    last = F.substring_index("label", "::", -1)
    hit = F.col("label").isin(list(names)) | last.isin(list(names))
    for p in patterns:
        hit = hit | F.col("label").rlike(paths.glob_regex(p)) | last.rlike(paths.glob_regex(p))
    if min_fan_in is not None:
        hit = hit | (F.col("fan_in") >= min_fan_in)
    return nodes.where((F.col("zone") == "dependency") & hit).orderBy("id")


def flat_bands(nodes: DataFrame) -> DataFrame:
    """nodes with band 0."""
    return nodes.withColumn("band", F.lit(0))


def two_bands(nodes: DataFrame) -> DataFrame:
    """nodes with band 0 for the target and 1 for all else."""
    return nodes.withColumn("band", F.when(F.col("zone") == "target", 0).otherwise(1))


def module_bands(nodes: DataFrame, names: list[str], fallback: str = "External") -> DataFrame:
    """nodes(module) with the place of their module among those that occur, in order of declaration.

    The fallback comes after the names and (ambiguous) last; unknown and null modules count as (ambiguous). The
    places are joined back from a table of at most as many rows as there are names.
    """
    order = {name: k for k, name in reversed(list(enumerate([*names, fallback, "(ambiguous)"])))}
    at = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    placed = nodes.withColumn("_at", F.coalesce(F.try_element_at(at, F.coalesce("module", F.lit(""))), F.lit(len(names) + 1)))
    found = placed.select("_at").distinct()
    dense = found.withColumn("band", F.row_number().over(Window.orderBy("_at")) - 1)
    return placed.join(F.broadcast(dense), "_at").select(*nodes.columns, "band")


def super_nodes(nodes: DataFrame, module: Column, level: str = "file") -> tuple[DataFrame, DataFrame]:
    """((id, grp), (grp, side, label, members, band)) for nodes(id, zone, path, band); module names dependency nodes.

    Target nodes fold by the name of their file without its last extension, or by its folder with level "dir".
    Nodes without a path fold into (external); a folded node has the smallest band of its members.
    """
    if level not in ("file", "dir"):
        raise ValueError(f"level {level!r} is neither file nor dir")
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=[^.])\.[^.]+$", "")
    own = base if level == "file" else paths.parent_dir(F.col("path"), ".")
    side = F.when(F.col("zone") == "target", "target").otherwise("dependency")
    label = F.when(F.coalesce("path", F.lit("")) == "", "(external)").when(side == "target", own).otherwise(module)
    named = nodes.select("id", "band", side.alias("side"), label.alias("label")).withColumn("grp", F.concat_ws(":", "side", "label"))
    folded = named.groupBy("grp", "side", "label").agg(F.count("*").alias("members"), F.min("band").alias("band"))
    return named.select("id", "grp"), folded


def quotient(edges: DataFrame, groups: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """(src, dst, edges, cross, bridge): edges(src, dst, cross, bridge) between what stands for their ends.

    A node of groups(id, grp) is stood for by its group if that is in collapsed(grp) (None: all of them), else by
    itself. Edges inside a group go, equal ones become one, and a flag holds if it holds for any of them.
    """
    if collapsed is not None:
        shut = collapsed.select("grp").distinct().withColumn("_shut", F.lit(True))
        groups = groups.join(shut, "grp", "left").withColumn("grp", F.when(F.col("_shut"), F.col("grp")))
    stand = groups.select("id", F.coalesce(F.col("grp").cast("string"), F.col("id").cast("string")).alias("rep"))
    a, b = stand.select(F.col("id").alias("src"), F.col("rep").alias("_a")), stand.select(F.col("id").alias("dst"), F.col("rep").alias("_b"))
    between = edges.join(a, "src").join(b, "dst").where("_a <> _b").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    return between.agg(F.count("*").alias("edges"), F.bool_or("cross").alias("cross"), F.bool_or("bridge").alias("bridge"))


def carried_confidence(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges(src, dst, relation) with the confidence of known(src, dst, relation, confidence), direct where it has none."""
    return edges.join(known, ["src", "dst", "relation"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("direct")))
