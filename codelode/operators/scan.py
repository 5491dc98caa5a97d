"""Bounded slices of code: out-edges resolved to targets, the target-dependency build, the N-way build and file neighbours.

Node ids are s<id> for a symbol, dep:<name> for a name that is outside, amb:<name> for a name that several symbols
inside have. A build without a budget is one join; with a budget nodes are taken in the order in which a reader that
goes symbol by symbol meets them, as an ordered limit, so no step holds more than the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.resolve import definitions
from codelode.scratch import cut

# Relations that cross a boundary, and names that are export macros rather than types.
RELATIONS = ("extends", "implements", "uses_type")
EXPORT_MACRO = "^[A-Z][A-Z0-9_]*_API$"
AMBIGUOUS = "(ambiguous)"


def out_edges(edges: DataFrame) -> DataFrame:
    """Edges of the boundary relations whose target is no export macro."""
    return edges.where(F.col("relation").isin(*RELATIONS) & ~F.coalesce(F.col("dst_name").rlike(EXPORT_MACRO), F.lit(False)))


def _direct(edges: DataFrame) -> Column:
    return F.col("dst_symbol_id") if "dst_symbol_id" in edges.columns else F.lit(None).cast("long")


def targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Out-edges with target, confidence and ambiguity for symbols(id, name, path, zone, start_byte, end_byte).

    direct: the edge has its symbol. unresolved: no symbol of the name. unique: one. ambiguous: several, amb: if all
    of them are in the target zone, else dep:. The candidates of a name are counted once, not once an edge.
    """
    per = definitions(symbols).groupBy(F.col("name").alias("dst_name")).agg(F.count("*").alias("n"), F.min("id").alias("only"), F.bool_and(F.col("zone") == "target").alias("inside"))
    j = out_edges(edges).withColumn("_direct", _direct(edges)).join(per, "dst_name", "left")
    return _named(j, F.col("only"), F.coalesce(F.col("n"), F.lit(0)), F.col("n") > 1, F.col("inside"))


def module_targets(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same for symbols with a module: several candidates in one module are the first by path and id, unique."""
    per = definitions(symbols).groupBy(F.col("name").alias("dst_name")).agg(
        F.count("*").alias("n"), F.min_by("id", F.struct("path", "id")).alias("only"), F.array_sort(F.collect_set("module")).alias("modules")
    )
    j = out_edges(edges).withColumn("_direct", _direct(edges)).join(per, "dst_name", "left")
    return _named(j, F.col("only"), F.coalesce(F.col("n"), F.lit(0)), F.size("modules") > 1, F.lit(True))


def _named(j: DataFrame, only: Column, n: Column, several: Column, inside: Column) -> DataFrame:
    several = F.coalesce(several, F.lit(False))
    symbol = lambda c: F.concat(F.lit("s"), c.cast("string"))
    outside = F.concat(F.lit("dep:"), F.coalesce("dst_name", F.lit("")))
    target = F.when(F.col("_direct").isNotNull(), symbol(F.col("_direct"))).when(n == 0, outside).when(~several, symbol(only))
    target = target.when(inside, F.concat(F.lit("amb:"), "dst_name")).otherwise(outside)
    confidence = F.when(F.col("_direct").isNotNull(), "direct").when(n == 0, "unresolved").when(~several, "unique").otherwise("ambiguous")
    ambiguity = F.when(F.col("_direct").isNotNull(), 0).otherwise(n).cast("long")
    cols = [c for c in ("id", "src_symbol_id", "relation", "dst_name") if c in j.columns]
    return j.select(*cols, F.col("_direct").alias("dst_symbol_id"), target.alias("target"), confidence.alias("confidence"), ambiguity.alias("ambiguity"))


@dataclass
class Build:
    """nodes(id, zone or module, depth), edges(src, dst, relation, weight, confidence) and what a budget left out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool = False
    elided: int = 0


def _met(found: DataFrame, have: DataFrame, room: int | None) -> DataFrame:
    """(id): new targets of found(target, o), the first room of them in the order of o."""
    new = found.join(have.select(F.col("id").alias("target")), "target", "left_anti").groupBy(F.col("target").alias("id")).agg(F.min("o").alias("o"))
    return (new if room is None else new.orderBy("o").limit(room)).select("id")


def _weighted(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge a (src, dst, relation) into nodes, with its weight and the confidence that came last."""
    kept = found.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return kept.groupBy("src", F.col("target").alias("dst"), "relation").agg(F.count("*").alias("weight"), F.max_by("confidence", "o").alias("confidence"))


def _expand(resolved: DataFrame, level: DataFrame) -> DataFrame:
    """The resolved out-edges of level(id, k): found(src, target, relation, confidence, o), o in order of the sources' k."""
    src = F.concat(F.lit("s"), F.col("src_symbol_id").cast("string"))
    j = resolved.withColumn("src", src).join(level.select(F.col("id").alias("src"), "k"), "src")
    order = F.struct("k", "relation", "dst_name", "dst_symbol_id", "id")
    return j.select("src", "target", "relation", "confidence", order.alias("o"))


def _zone_of(nodes: DataFrame, symbols: DataFrame, column: str, outside: str) -> DataFrame:
    """nodes with their zone or module: that of the symbol, else outside for dep: and (ambiguous) or target for amb:."""
    s = symbols.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col(column))
    amb = F.lit("target" if column == "zone" else AMBIGUOUS)
    j = nodes.join(s, "id", "left")
    return j.withColumn(column, F.coalesce(column, F.when(F.col("id").startswith("amb:"), amb).otherwise(F.lit(outside))))


def boundary_build(edges: DataFrame, symbols: DataFrame, max_nodes: int | None = None, dep_depth: int = 1) -> Build:
    """All target symbols, their out-edges and what these lead to; with dep_depth 2 the dependency symbols met go once more.

    symbols(id, name, path, zone, start_byte, end_byte). Nodes first met at depth 2 have depth 2 (the dependency's core).
    """
    seeds = symbols.where("zone = 'target'").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.struct("path", F.col("id").alias("n")).alias("k"))
    total = None
    if max_nodes is not None:
        total = seeds.count()
        seeds = seeds.orderBy("k").limit(max_nodes)
    resolved = cut(targets(edges, symbols)) if dep_depth >= 2 else targets(edges, symbols)
    nodes = cut(seeds.select("id", F.lit(0).alias("depth")))
    found = _expand(resolved, seeds)
    room = None if max_nodes is None else max(0, max_nodes - nodes.count())
    met = cut(_met(found, nodes, room).withColumn("depth", F.lit(1)))
    nodes = nodes.unionByName(met)
    all_found = found
    if dep_depth >= 2:
        surface = _zone_of(met, symbols, "zone", "dependency").where("zone = 'dependency' AND id LIKE 's%'").select("id", F.struct("id").alias("k"))
        more = _expand(resolved, surface)
        room = None if max_nodes is None else max(0, max_nodes - nodes.count())
        core = cut(_met(more, nodes, room).withColumn("depth", F.lit(2)))
        nodes = nodes.unionByName(core)
        got = [_weighted(found, nodes.where("depth < 2")), _weighted(more, nodes)]
        edges_out = got[0].unionByName(got[1])
        all_found = found.select("src", "target").unionByName(more.select("src", "target"))
    else:
        edges_out = _weighted(found, nodes)
    out = Build(_zone_of(nodes, symbols, "zone", "dependency"), edges_out)
    if max_nodes is not None:
        out.elided = total - min(total, max_nodes) + all_found.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").count()
        out.truncated = out.elided > 0
    return out


def modules_build(edges: DataFrame, symbols: DataFrame, declared_order: list[str], fallback: str = "External", max_nodes: int | None = None, dep_depth: int = 1) -> Build:
    """The N-way build: seeds of every declared module, then rounds of expansion of what they meet in declared modules.

    symbols(id, name, path, module, start_byte, end_byte). Symbols of the fallback module and names are sinks; with
    dep_depth 2 fallback symbols go once more. With a budget each module gets an equal share of three fifths of it, and
    seeds are dealt one a module in turn, in the order in which the modules are declared.
    """
    spec_zones = len(declared_order)
    place = F.coalesce(*[F.when(F.col("module") == name, F.lit(k)) for k, name in enumerate(declared_order)], F.lit(spec_zones))
    declared = symbols.where(F.col("module") != fallback)
    seeds = declared.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), "module", F.struct("path", F.col("id").alias("n")).alias("k"))
    elided = 0
    if max_nodes is not None:
        share = max(1, max(spec_zones, max_nodes * 3 // 5) // max(1, spec_zones))
        rank = F.row_number().over(Window.partitionBy("module").orderBy("k"))
        seeds = seeds.withColumn("k", F.struct(rank.alias("r"), place.alias("decl"), F.col("k"))).where(F.col("k.r") <= share)
        total = seeds.count()
        seeds = seeds.orderBy("k").limit(max_nodes)
        elided += max(0, total - max_nodes)
    resolved = cut(module_targets(edges, symbols))  # read by every round
    known = symbols.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), "module")
    nodes = cut(seeds.select("id", F.lit(0).alias("depth")))
    level, parts, depth = cut(seeds.select("id", "k")), [], 0
    while True:
        depth += 1
        found = cut(_expand(resolved, level))
        room = None if max_nodes is None else max(0, max_nodes - nodes.count())
        met = cut(_met(found, nodes, room).withColumn("depth", F.lit(depth)))
        nodes = cut(nodes.unionByName(met))
        parts.append(_weighted(found, nodes))
        if max_nodes is not None:
            elided += found.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").count()
        level = cut(met.join(known.where(F.col("module") != fallback), "id").select("id", F.struct("id").alias("k")))
        if not level.take(1):
            break
    if dep_depth >= 2:
        surface = nodes.join(known.where(F.col("module") == fallback), "id").select("id", F.struct("id").alias("k"))
        found = cut(_expand(resolved, surface))
        room = None if max_nodes is None else max(0, max_nodes - nodes.count())
        nodes = cut(nodes.unionByName(_met(found, nodes, room).withColumn("depth", F.lit(depth + 1))))
        parts.append(_weighted(found, nodes))
        if max_nodes is not None:
            elided += found.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Build(_zone_of(nodes, symbols, "module", fallback), out, elided > 0, elided)


def symbol_seeds(symbols: DataFrame, name: str) -> DataFrame:
    """Target symbols of an exact name, by id."""
    return symbols.where((F.col("name") == name) & (F.col("zone") == "target")).select("id").orderBy("id")


def neighbours(import_edges: DataFrame, files: DataFrame, direction: str = "out", most: int | None = 40) -> DataFrame:
    """(id, other) of files(id): what a file imports, what imports it, or both; itself and unresolved imports are skipped.

    import_edges(file_id, dst_file_id) is the resolved import table, so the reverse needs no search. most bounds the
    importers of a file, first by id, as a reader with a budget would; None gives all.
    """
    e = import_edges.where("dst_file_id IS NOT NULL AND file_id <> dst_file_id").select(F.col("file_id").alias("a"), F.col("dst_file_id").alias("b")).distinct()
    out = e.select(F.col("a").alias("id"), F.col("b").alias("other"))
    back = e.select(F.col("b").alias("id"), F.col("a").alias("other"))
    if most is not None:
        back = back.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("other"))).where(F.col("_n") <= most).drop("_n")
    found = {"out": out, "in": back, "both": out.unionByName(back).distinct()}[direction]
    return found.join(files.select("id"), "id", "left_semi")
