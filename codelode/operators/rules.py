"""Ordered rewrite rules over symbol rows, as a fold of column expressions."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import paths

ACTIONS = ("rename_to_next_identifier", "set_attr", "drop", "reclassify")


def validate(rules: list[dict]) -> list[str]:
    """What is wrong with a list of rules, in order."""
    wrong, seen = [], set()
    for k, r in enumerate(rules):
        where = f"rule {r.get('id', k)}"
        if not isinstance(r.get("id"), str) or not r.get("id"):
            wrong.append(f"{where}: id is missing")
        elif r["id"] in seen:
            wrong.append(f"{where}: id is used twice")
        seen.add(r.get("id"))
        if r.get("action") not in ACTIONS:
            wrong.append(f"{where}: action {r.get('action')!r} is unknown")
        if r.get("action") == "set_attr" and not isinstance(r.get("attrs"), dict):
            wrong.append(f"{where}: set_attr wants attrs")
        if r.get("action") == "reclassify" and not r.get("kind_to"):
            wrong.append(f"{where}: reclassify wants kind_to")
        for key in set(r.get("when", {})) - {"lang", "kind", "name_regex", "path_glob"}:
            wrong.append(f"{where}: predicate {key!r} is unknown")
        try:
            re.compile(r.get("when", {}).get("name_regex", ""))
        except re.error as e:
            wrong.append(f"{where}: name_regex: {e}")
    return wrong


def merge(project: list[dict], presets: dict[str, dict], use: list[str]) -> list[dict]:
    """Rules of presets depth-first, each preset once, then the project's; a project rule takes the place of its id."""
    out: dict[str, dict] = {}
    seen: set[str] = set()

    def load(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        doc = presets.get(name, {})
        for other in doc.get("extends", []):
            load(other)
        for r in doc.get("rules", []):
            out[r["id"]] = {**r, "origin": name}

    for name in use:
        load(name)
    for r in project:
        out[r["id"]] = {**r, "origin": "project"}
    return list(out.values())


def _document(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        doc = json.load(f)
    if not isinstance(doc, dict):
        raise ValueError(f"{path} holds no rules document")
    return doc


def load(path: str, preset_dirs: list[str] = ()) -> list[dict]:
    """The rules of a document and of the presets it extends, each with its ``_origin``; no document, no rules.

    A preset NAME is NAME.rules.json in a folder the extending document names (relative to itself) or in
    preset_dirs. What a preset extends comes before its own rules and no preset comes twice, so circles end. The
    document's rules come last, but one with the id of an earlier rule takes that rule's place.
    """
    rows: list[dict] = []
    if not os.path.exists(path):
        return rows
    met: set[str] = set()

    def presets(doc: dict, at: str) -> None:
        folders = [*(os.path.join(at, d) for d in doc.get("preset_dirs") or ()), *preset_dirs]
        for name in doc.get("extends_presets") or ():
            if name in met:
                continue
            met.add(name)
            found = next((p for d in folders if os.path.exists(p := os.path.join(d, f"{name}.rules.json"))), None)
            if found is None:
                raise ValueError(f"preset {name!r} is in none of {folders}")
            more = _document(found)
            presets(more, os.path.dirname(found))
            rows.extend({"_origin": f"preset:{name}", **r} for r in more.get("rules") or ())

    own = _document(path)
    presets(own, os.path.dirname(path))
    place = {r["id"]: k for k, r in enumerate(rows) if r.get("id")}
    for r in own.get("rules") or ():
        r = {"_origin": "project", **r}
        at = place.setdefault(r["id"], len(rows)) if r.get("id") else len(rows)
        rows[at : at + 1] = [r]
    return rows


def applies(when: dict) -> Column:
    """AND of lang, kind, whole-name regular expression and path pattern (ignored on rows without a path)."""
    cond = F.lit(True)
    if "lang" in when:
        cond = cond & F.coalesce(F.col("lang") == when["lang"], F.lit(False))
    if "kind" in when:
        cond = cond & F.coalesce(F.col("kind") == when["kind"], F.lit(False))
    if "name_regex" in when:
        cond = cond & F.coalesce(F.col("name"), F.lit("")).rlike(f"^(?:{when['name_regex']})$")
    if "path_glob" in when:
        cond = cond & (F.col("path").isNull() | F.col("path").rlike(paths.glob_regex(when["path_glob"])))
    return cond


def apply(symbols: DataFrame, rules: list[dict], next_identifier: Callable[[], Column] | None = None) -> DataFrame:
    """Rows after all rules; later rules see what earlier ones did. provenance lists the rules that touched a row.

    symbols: name, kind, lang, path, attrs map<string,string>, provenance array<string>, and line for renames.
    """
    rows = symbols.withColumn("_gone", F.lit(False))
    for r in rules:
        rows = rows.withColumn("_hit", ~F.col("_gone") & applies(r.get("when", {})))
        change: dict[str, Column] = {}
        if r["action"] == "drop":
            change["_gone"] = F.col("_gone") | F.col("_hit")
        elif r["action"] == "reclassify":
            change["kind"] = F.when(F.col("_hit"), F.lit(r["kind_to"])).otherwise(F.col("kind"))
        elif r["action"] == "set_attr":
            new = F.create_map(*[F.lit(str(x)) for kv in sorted(r["attrs"].items()) for x in kv])
            own = [str(k) for k in r["attrs"]]
            kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), _none_of(own))
            change["attrs"] = F.when(F.col("_hit"), F.map_concat(kept, new)).otherwise(F.col("attrs"))
        else:
            nxt = F.regexp_extract("line", r"[A-Za-z_]\w*\W+([A-Za-z_]\w*)", 1) if next_identifier is None else next_identifier()
            change["name"] = F.when(F.col("_hit") & (nxt != ""), nxt).otherwise(F.col("name"))
        note = F.concat(F.coalesce("provenance", F.array().cast("array<string>")), F.array(F.lit(r["id"])))
        change["provenance"] = F.when(F.col("_hit"), note).otherwise(F.col("provenance"))
        rows = rows.withColumns(change)
    return rows.where(~F.col("_gone")).drop("_gone", "_hit")


def _none_of(names: list[str]):
    return lambda k, v: ~k.isin(names)


def drop_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose source, and whose target where it has one, is still there."""
    ids = kept.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src_symbol_id"), "src_symbol_id", "left_semi")
    if "dst_symbol_id" not in edges.columns:
        return e
    named = e.where("dst_symbol_id IS NULL")
    return named.unionByName(e.where("dst_symbol_id IS NOT NULL").join(ids.withColumnRenamed("id", "dst_symbol_id"), "dst_symbol_id", "left_semi").select(named.columns))


def preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): rows that rules would drop, rename or reclassify."""
    b = before.select("id", F.col("name").alias("n0"), F.col("kind").alias("k0"))
    a = after.select("id", F.col("name").alias("n1"), F.col("kind").alias("k1"))
    j = b.join(a, "id", "left")
    change = (
        F.when(F.col("k1").isNull(), F.concat(F.lit("drop "), "k0", F.lit(" "), "n0"))
        .when((F.col("n0") != F.col("n1")) | (F.col("k0") != F.col("k1")), F.concat("k0", F.lit(" "), "n0", F.lit(" -> "), "k1", F.lit(" "), "n1"))
    )
    return j.select("id", change.alias("change")).where("change IS NOT NULL")


def prune_ifdef(lines: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """lines(file_id, line_no, line) without the 1-based inclusive spans(file_id, first, last, condition) that name no kept macro."""
    names = F.regexp_extract_all("condition", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    gone = spans.where(~F.arrays_overlap(names, F.array(*map(F.lit, keep)) if keep else F.array().cast("array<string>")))
    cut = gone.select("file_id", F.explode(F.sequence("first", "last")).alias("line_no"))
    return lines.join(cut, ["file_id", "line_no"], "left_anti")
