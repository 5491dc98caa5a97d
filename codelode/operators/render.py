"""Deterministic text and JSON of bounded graphs.

Labels, identifiers and lines are column expressions; the driver only takes finished lines in order, and no more than
BUDGET of them: a slice that is larger than that is an error, not a page.
"""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text

BUDGET = 100_000


def take(rows: DataFrame, value: Column, order: list, budget: int = BUDGET) -> list[str]:
    """The values of all rows in order; ValueError if there are over budget."""
    got = rows.select(value.alias("_v"), *[F.expr(o).alias(f"_o{k}") if isinstance(o, str) else o.alias(f"_o{k}") for k, o in enumerate(order)])
    got = got.orderBy(*[f"_o{k}" for k in range(len(order))]).limit(budget + 1).select("_v").collect()
    if len(got) > budget:
        raise ValueError(f"over {budget} rows to render")
    return [r._v for r in got]


def _label(nodes: DataFrame) -> Column:
    name = F.col("id").cast("string")
    return text.escape_label(F.coalesce(F.col("label").cast("string"), name) if "label" in nodes.columns else name)


def _relation(edges: DataFrame) -> Column:
    return text.escape_label(F.coalesce(F.col("relation").cast("string"), F.lit(""))) if "relation" in edges.columns else F.lit("")


def _more(nodes: DataFrame, frontier: dict | None, form: str) -> Column:
    """What a node's label says of the neighbours left out: form % n, or nothing."""
    if not frontier:
        return F.lit("")
    known = F.create_map(*[F.lit(x) for k, v in sorted(frontier.items(), key=lambda kv: str(kv[0])) for x in (str(k), form % v)])
    return F.coalesce(F.try_element_at(known, F.col("id").cast("string")), F.lit(""))


def _order(edges: DataFrame) -> list:
    return [F.col("src").cast("string"), F.col("dst").cast("string"), *([F.coalesce(F.col("relation").cast("string"), F.lit(""))] if "relation" in edges.columns else [])]


def _node_order() -> list:
    return [F.col("id").cast("string")]


def to_json(nodes: DataFrame, edges: DataFrame, bounded: dict | None = None) -> str:
    """Sorted nodes and edges with all their columns, and what was left out."""
    n = take(nodes, F.to_json(F.struct(*sorted(nodes.columns)), {"ignoreNullFields": "false"}), _node_order())
    e = take(edges, F.to_json(F.struct(*sorted(edges.columns)), {"ignoreNullFields": "false"}), _order(edges))
    return f'{{"bounded": {json.dumps(bounded or {}, sort_keys=True)}, "edges": [{", ".join(e)}], "nodes": [{", ".join(n)}]}}'


def to_mermaid(nodes: DataFrame, edges: DataFrame, frontier: dict | None = None, truncated: bool = False, level: int = 0, elided: int = 0, depth_bounded: bool = False) -> str:
    head = ["flowchart TD"]
    head += [f"  %% truncated at level {level}: {elided} deps elided"] * truncated + [f"  %% depth-bounded at level {level}"] * depth_bounded
    node = F.concat(F.lit("  "), text.mermaid_id(F.col("id").cast("string")), F.lit('["'), _label(nodes), _more(nodes, frontier, " +%s⤳"), F.lit('"]'))
    edge = F.concat(F.lit("  "), text.mermaid_id(F.col("src").cast("string")), F.lit(" -->|"), _relation(edges), F.lit("| "), text.mermaid_id(F.col("dst").cast("string")))
    return "\n".join([*head, *take(nodes, node, _node_order()), *take(edges, edge, _order(edges))]) + "\n"


def to_dot(nodes: DataFrame, edges: DataFrame, frontier: dict | None = None, truncated: bool = False, level: int = 0, elided: int = 0) -> str:
    head = ["digraph slice {", "  rankdir=LR;"] + [f'  label="truncated@L{level}: {elided} elided"; labelloc=b;'] * truncated
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    node = F.concat(F.lit("  "), quoted("id"), F.lit(' [label="'), _label(nodes), _more(nodes, frontier, " (+%s)"), F.lit('"];'))
    edge = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(' [label="'), _relation(edges), F.lit('"];'))
    return "\n".join([*head, *take(nodes, node, _node_order()), *take(edges, edge, _order(edges)), "}"]) + "\n"


def to_text(nodes: DataFrame, edges: DataFrame) -> str:
    lines = take(nodes, F.concat(F.col("id").cast("string"), F.lit("\t"), _label(nodes)), _node_order())
    return f"{len(lines)} nodes, {edges.count()} edges\n" + "".join(x + "\n" for x in lines)


def metrics_json(summary: DataFrame, coupling: DataFrame, components: DataFrame, bridges: DataFrame, cuts: DataFrame, layers: DataFrame, leftover: DataFrame, bounded: dict | None = None) -> str:
    """The metrics bundle of a slice as one document; nodes by instability, fan-out and id."""
    parts = {
        "summary": take(summary, F.to_json(F.struct("*")), [F.lit(1)])[0],
        "bounded": json.dumps(bounded or {}, sort_keys=True),
        "nodes": take(coupling, F.to_json(F.struct("*")), [-F.col("instability"), -F.col("ce"), F.col("id")]),
        "cycles": take(components.where("cyclic").groupBy("slice", "component").agg(F.array_sort(F.collect_list("id")).alias("ids")), F.to_json("ids"), ["component"]),
        "bridges": take(bridges, F.to_json(F.array("a", "b")), ["a", "b"]),
        "cut_nodes": take(cuts, F.col("id").cast("string"), ["id"]),
        "layers": take(layers.groupBy("layer").agg(F.array_sort(F.collect_list("id")).alias("ids")), F.to_json("ids"), ["layer"]),
        "leftover": take(leftover, F.col("id").cast("string"), ["id"]),
    }
    return "{" + ", ".join(f'"{k}": ' + (v if isinstance(v, str) else "[" + ", ".join(v) + "]") for k, v in parts.items()) + "}"


def modules_json(matrix: DataFrame, by_relation: DataFrame, fans: DataFrame, needed: DataFrame, cuts: DataFrame, cycles: DataFrame, zones: list[str], fallback: str = "External", bounded: dict | None = None) -> str:
    """The N-way module report as one document with sorted keys and rows."""
    rel = by_relation.groupBy("sm", "dm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "edge_count")))).alias("by_relation"))
    kind = F.when(F.col("sm") == F.col("dm"), "intra").otherwise("cross")
    pair = matrix.join(rel, ["sm", "dm"]).select("sm", "dm", F.to_json(F.struct("by_relation", F.col("dm").alias("dst"), "edge_count", kind.alias("kind"), F.col("sm").alias("src"), "weight")).alias("j"))
    want = needed.groupBy("sm", "dm").agg(F.array_sort(F.collect_list(F.struct("dst", "label", "ref_count", F.split("relations", ",").alias("relations")))).alias("symbols"))
    ring = cycles.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("size").alias("size")).where("size > 1")
    parts = {
        "bounded": json.dumps(bounded or {}, sort_keys=True),
        "cut_costs": take(cuts, F.to_json(F.struct("cost", F.col("dm").alias("dst"), "edge_count", F.col("sm").alias("src"))), ["cost", "sm", "dm"]),
        "cycles": take(ring, F.to_json("ids"), ["component"]),
        "fallback": json.dumps(fallback),
        "matrix": take(pair, F.col("j"), ["sm", "dm"]),
        "modules": take(fans, F.to_json(F.struct("fan_in", "fan_out", "instability", "module")), ["module"]),
        "needed": take(want, F.to_json(F.struct(F.col("dm").alias("dst"), F.col("sm").alias("src"), "symbols")), ["sm", "dm"]),
        "zones": json.dumps(zones),
    }
    return "{" + ", ".join(f'"{k}": ' + (v if isinstance(v, str) else "[" + ", ".join(v) + "]") for k, v in parts.items()) + "}"


def metrics_text(summary: DataFrame, coupling: DataFrame, most: int = 10) -> str:
    """The summary line by line and the most unstable nodes."""
    head = summary.first().asDict()
    line = F.concat_ws("\t", "id", "ca", "ce", "instability")
    top = coupling.orderBy(-F.col("instability"), -F.col("ce"), "id").limit(most)
    return "".join(f"{k}: {v}\n" for k, v in head.items()) + "id\tca\tce\tinstability\n" + "".join(x + "\n" for x in take(top, line, [-F.col("instability"), -F.col("ce"), F.col("id")]))


def tsv(rows: DataFrame, order: list, budget: int = BUDGET) -> str:
    """A header and one line a row, cells cleaned of tabs and line ends."""
    line = F.concat_ws("\t", *[text.tsv_cell(F.col(c)) for c in rows.columns])
    return "\t".join(rows.columns) + "\n" + "".join(x + "\n" for x in take(rows, line, order, budget))


def coordinates(ids: list, band: dict, zone: dict) -> dict:
    """Start positions: a circle of 120, shifted by band and zone, to three digits."""
    out = {}
    for k, i in enumerate(sorted(ids, key=str)):
        a = 2 * math.pi * k / max(1, len(ids))
        side = {"target": -220, "dependency": 220}.get(zone.get(i), 0)
        out[i] = (round(120 * math.cos(a) + 520 * band.get(i, 0), 3), round(120 * math.sin(a) + side, 3))
    return out


def node_size(degree: int, most: int, hub: bool) -> float:
    size = 4 + degree / max(1, most) * 11
    return round(max(size, 12) + 4 if hub else size, 2)


def to_html(nodes: DataFrame, edges: DataFrame, title: str = "graph") -> str:
    """One self-contained page: data as JSON and a small table view."""
    data = to_json(nodes, edges).replace("</", "<\\/")
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table id=t></table>"
        f"<script>const G={data};for(const e of G.edges){{const r=document.getElementById('t').insertRow();"
        "for(const k of ['src','relation','dst'])r.insertCell().textContent=e[k]??''}</script>"
    )


FORMATS = {"json": to_json, "mermaid": to_mermaid, "dot": to_dot, "text": to_text, "html": to_html}
