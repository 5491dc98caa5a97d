"""Where the nodes and edges of a scan come from: adapters over tables, and the scan that asks them level by level.

An adapter finds the nodes that a seed names and, for the nodes of one level, their neighbours. It resolves what the
level needs and no more: a level has at most as many nodes as the scan's budget. Node ids are text: ``file:<id>``,
``s<id>`` for symbols, ``dep:<name>`` and ``amb:<name>`` for names without one symbol.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import paths
from codelode.operators import graph, resolve, scan, search

SEEDS, IMPORTERS = 25, 40


@runtime_checkable
class Adapter(Protocol):
    name: str

    def seeds(self, seed: str, limit: int = SEEDS) -> DataFrame:
        """(id) of the nodes that a seed names; none if it names nothing."""

    def neighbours(self, level: DataFrame, direction: str = "out") -> DataFrame:
        """(src, dst, relation, path, line, confidence, back) of the edges at the nodes of level(id): src is of the level, and the edge leads to it where back is set."""


def _edges(rows: DataFrame, src, dst, relation, path, line, confidence, back: bool) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), relation.alias("relation"), path.alias("path"), line.cast("long").alias("line"), confidence.alias("confidence"), F.lit(back).alias("back"))


class FileAdapter:
    """Files and what they import, from files(id, path, content), symbols(id, file_id, name, path) and raw imports(file_id, path, line, kind, target)."""

    name = "file"

    def __init__(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, importers: int = IMPORTERS):
        self.files, self.symbols, self.imports, self.importers = files, symbols, imports, importers

    def seeds(self, seed: str, limit: int = SEEDS) -> DataFrame:
        return search.staged_seeds(self.files, self.symbols, seed, limit).select(F.concat(F.lit("file:"), F.col("id").cast("string")).alias("id"))

    def neighbours(self, level: DataFrame, direction: str = "out") -> DataFrame:
        here = level.where(F.startswith("id", F.lit("file:"))).select(F.substring("id", 6, 20).cast("long").alias("file_id"))
        places = self.imports.select("file_id", "line", "target", "path").distinct()
        name = lambda c: F.concat(F.lit("file:"), F.col(c).cast("string"))
        first = F.min(F.struct("line", "path")).alias("at")
        out = None
        if direction in ("out", "both"):
            mine = resolve.resolve_imports(self.imports.join(F.broadcast(here), "file_id", "left_semi"), self.files).where("dst_file_id <> file_id")
            once = mine.join(places, ["file_id", "line", "target"]).groupBy("file_id", "dst_file_id").agg(first)
            out = _edges(once, name("file_id"), name("dst_file_id"), F.lit("imports"), F.col("at.path"), F.col("at.line"), F.lit("direct"), False)
        if direction in ("in", "both"):
            # only imports with a candidate of a wanted base name can lead here
            base = self.files.join(F.broadcast(here.withColumnRenamed("file_id", "id")), "id", "left_semi").select(paths.base_name(F.col("path")).alias("base")).distinct()
            may = resolve.import_candidates(self.imports).withColumn("base", paths.base_name(paths.normalise(F.col("cand")))).join(F.broadcast(base), "base", "left_semi")
            some = self.imports.join(may.select("file_id", "line", "target").distinct(), ["file_id", "line", "target"], "left_semi")
            led = resolve.resolve_imports(some, self.files).join(F.broadcast(here.withColumnRenamed("file_id", "dst_file_id")), "dst_file_id", "left_semi").where("dst_file_id <> file_id")
            once = led.join(places, ["file_id", "line", "target"]).groupBy("file_id", "dst_file_id").agg(first)
            few = once.withColumn("_n", F.row_number().over(Window.partitionBy("dst_file_id").orderBy("file_id"))).where(F.col("_n") <= self.importers)
            back = _edges(few, name("dst_file_id"), name("file_id"), F.lit("imports"), F.col("at.path"), F.col("at.line"), F.lit("direct"), True)
            out = back if out is None else out.unionByName(back)
        return out


class SymbolAdapter:
    """Symbols of the target zone and what they lead to, from edges and symbols(id, name, path, zone, start_byte, end_byte[, start_line]).

    Symbols of other zones and names are sinks. Edges lead out only.
    """

    name = "symbol"

    def __init__(self, edges: DataFrame, symbols: DataFrame):
        self.edges, self.symbols = edges, symbols if "start_line" in symbols.columns else symbols.withColumn("start_line", F.lit(None).cast("long"))

    def seeds(self, seed: str, limit: int = SEEDS) -> DataFrame:
        named = search.symbols_named(self.symbols, seed, limit=limit)
        return named.where("zone = 'target'").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))

    def neighbours(self, level: DataFrame, direction: str = "out") -> DataFrame:
        here = level.where(F.col("id").rlike("^s[0-9]+$")).select(F.substring("id", 2, 20).cast("long").alias("src_symbol_id"))
        open_ = self.symbols.where("zone = 'target'").select(F.col("id").alias("src_symbol_id"), F.col("path").alias("_path"), F.col("start_line").alias("_line")).join(F.broadcast(here), "src_symbol_id", "left_semi")
        mine = self.edges.join(F.broadcast(open_.select("src_symbol_id")), "src_symbol_id", "left_semi")
        names = self.symbols.join(F.broadcast(mine.select(F.col("dst_name").alias("name")).distinct()), "name", "left_semi")  # names of a level's edges
        found = scan.targets(mine, names).join(F.broadcast(open_), "src_symbol_id")
        return _edges(found, F.concat(F.lit("s"), F.col("src_symbol_id").cast("string")), F.col("target"), F.col("relation"), F.col("_path"), F.col("_line"), F.col("confidence"), False)


def scan_from(adapter: Adapter, seed: str, max_nodes: int = 200, max_depth: int = 3, direction: str = "out", limit: int = SEEDS) -> graph.Slice:
    """The bounded slice around what a seed names; an empty one if it names nothing.

    Edges are (src, dst, relation, weight, path, line, confidence): one for each pair and relation, with the first place it stands.
    """
    got = graph.expand(lambda level: adapter.neighbours(level, direction), adapter.seeds(seed, limit), max_nodes, max_depth)
    turned = F.struct(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"))
    e = got.edges.select(turned.alias("e"), "relation", "path", "line", "confidence").distinct()
    place = F.min(F.struct("path", "line", "confidence")).alias("at")
    e = e.groupBy("e.src", "e.dst", "relation").agg(F.count("*").alias("weight"), place)
    got.edges = e.select("src", "dst", "relation", "weight", "at.path", "at.line", "at.confidence")
    return got
