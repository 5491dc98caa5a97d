"""S-expression files: reading, validation, equivalence, and links from nodes to source classes."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

MAX_DIFFS = 50
PREFIXES = ("U", "A", "F", "")


class Node:
    """An atom (text) or a list (items) with its byte span and line."""

    __slots__ = ("text", "items", "start", "end", "line")

    def __init__(self, text, items, start, end, line):
        self.text, self.items, self.start, self.end, self.line = text, items, start, end, line

    @property
    def head(self) -> str | None:
        return self.items[0].text if self.items and self.items[0].items is None else None


def parse(source: str) -> tuple[list[Node], list[tuple[str, int, int]]]:
    """(top-level nodes, problems as (code, line, byte)). Comments run from ; to the line end; strings are double-quoted."""
    data = source.encode()
    stack: list[Node] = [Node(None, [], 0, len(data), 1)]
    wrong, i, line = [], 0, 1
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\n":
            line += 1
            i += 1
        elif c.isspace():
            i += 1
        elif c == b";":
            end = data.find(b"\n", i)
            i = len(data) if end < 0 else end
        elif c == b"(":
            node = Node(None, [], i, i, line)
            stack[-1].items.append(node)
            stack.append(node)
            i += 1
        elif c == b")":
            if len(stack) == 1:
                wrong.append(("unbalanced-close", line, i))
            else:
                stack.pop().end = i + 1
            i += 1
        elif c == b'"':
            end = i + 1
            while end < len(data) and data[end : end + 1] != b'"':
                end += 2 if data[end : end + 1] == b"\\" else 1
            if end >= len(data):
                wrong.append(("unterminated-string", line, i))
            raw = data[i : end + 1].decode("utf-8", "replace")
            stack[-1].items.append(Node(raw, None, i, min(end + 1, len(data)), line))
            line += raw.count("\n")
            i = end + 1
        else:
            end = i
            while end < len(data) and data[end : end + 1] not in (b"(", b")", b'"', b";") and not data[end : end + 1].isspace():
                end += 1
            stack[-1].items.append(Node(data[i:end].decode("utf-8", "replace"), None, i, end, line))
            i = end
    wrong += [("unclosed-list", n.line, n.start) for n in stack[1:]]
    return stack[0].items, wrong


def pairs(node: Node) -> dict[str, Node]:
    """Keyword arguments of a list, the first of each key."""
    out: dict[str, Node] = {}
    items = node.items or []
    for a, b in zip(items, items[1:]):
        if a.text and a.text.startswith(":") and a.text not in out:
            out[a.text] = b
    return out


def walk(nodes: list[Node]):
    for n in nodes:
        if n.items is not None:
            yield n
            yield from walk(n.items)


def _graph(nodes: list[Node]):
    """Named nodes and the references between them: (node name)... and (ref name)."""
    named = [(n.items[1].text, n) for n in walk(nodes) if n.head == "node" and len(n.items) > 1 and n.items[1].text]
    refs = [(name, r.items[1].text, r) for name, n in named for r in walk(n.items) if r.head == "ref" and len(r.items) > 1 and r.items[1].text]
    return named, refs


REQUIRED = {"matlang": ("material", "outputs"), "bplisp": ("graph",), "animlang": ("graph",)}


def validate(source: str, lang: str, schema: dict | None = None) -> list[tuple[str, str, str, int, int]]:
    """(severity, code, message, line, byte), sorted by byte, code and message. Semantic passes need a schema."""
    from codelode.operators.graph import strong_components_of

    nodes, wrong = parse(source)
    out = [("error", code, code.replace("-", " "), line, byte) for code, line, byte in wrong]
    heads = {n.head for n in walk(nodes)}
    out += [("error", "missing-form", f"form {f} is missing", 1, 0) for f in REQUIRED.get(lang, ()) if f not in heads]
    named, refs = _graph(nodes)
    count = Counter(name for name, _ in named)
    seen: set[str] = set()
    for name, n in named:
        if name in seen:
            out.append(("error", "duplicate-id", f"node {name} is defined again", n.line, n.start))
        seen.add(name)
    outer = "error" if lang == "matlang" else "warning"
    out += [(outer, "dangling-ref", f"{a} refers to {b}, which is not defined", r.line, r.start) for a, b, r in refs if b not in count]
    if lang == "matlang" and max(count.values(), default=0) <= 1:
        ids = {name: k for k, name in enumerate(count)}
        comp = strong_components_of([(ids[a], ids[b]) for a, b, _ in refs if b in ids])
        loops = {a for a, b, _ in refs if a == b}
        size = Counter(comp.values())
        first = dict(reversed(named))
        done = set()
        for name, k in ids.items():
            root = comp.get(k)
            if (root is not None and size[root] > 1 and root not in done) or (name in loops and root not in done):
                done.add(root)
                out.append(("error", "cycle", f"node {name} is part of a cycle", first[name].line, first[name].start))
    if schema:
        types = schema.get(lang, {})
        for name, n in named:
            kind = n.items[2].text if len(n.items) > 2 and n.items[2].items is None else None
            if kind not in types:
                out.append(("warning", "unknown-type", f"type {kind} of {name} is unknown", n.line, n.start))
                continue
            have = {k[1:] for k in pairs(n)}
            known = set(types[kind].get("properties", ())) | set(types[kind].get("pins", {}))
            out += [("warning", "unknown-prop", f"{name} has unknown {p}", n.line, n.start) for p in sorted(have - known)]
            out += [("error", "missing-pin", f"{name} lacks pin {p}", n.line, n.start) for p, d in sorted(types[kind].get("pins", {}).items()) if d.get("required") and p not in have]
    return sorted(out, key=lambda r: (r[4], r[1], r[2]))


def validate_files(files: DataFrame, lang: str, schema: dict | None = None) -> DataFrame:
    """(id, severity, code, message, line, byte) of every file's issues."""

    def run(batches):
        for pdf in batches:
            rows = [(i, *issue) for i, src in zip(pdf.id, pdf.content) for issue in validate(src or "", lang, schema)]
            yield pd.DataFrame(rows, columns=["id", "severity", "code", "message", "line", "byte"]).astype({"id": "int64", "line": "int64", "byte": "int64"})

    return files.select("id", "content").mapInPandas(run, "id long, severity string, code string, message string, line long, byte long")


def number(text: str) -> Fraction | None:
    try:
        return Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


def canonical(node: Node, ignore: frozenset = frozenset()):
    """A tree whose keyword pairs are ordered by key (equal keys keep their order) and whose numbers compare by value."""
    if node.items is None:
        value = number(node.text) if not node.text.startswith('"') else None
        return ("number", value) if value is not None else ("atom", node.text)
    plain, keyed, i = [], [], 0
    while i < len(node.items):
        item = node.items[i]
        if item.items is None and item.text.startswith(":"):
            # a keyword before another keyword or at the end is a flag, without a value
            after = node.items[i + 1] if i + 1 < len(node.items) else None
            flag = after is None or (after.items is None and after.text.startswith(":"))
            if item.text not in ignore and item.text[1:] not in ignore:
                keyed.append((item.text, ("atom", "") if flag else canonical(after, ignore)))
            i += 1 if flag else 2
        else:
            plain.append(canonical(item, ignore))
            i += 1
    return ("list", tuple(plain), tuple(sorted(keyed, key=lambda kv: kv[0])))


def differences(a, b, path: str = "", out: list | None = None) -> list[tuple[str, str]]:
    """(path, what differs) of two canonical trees, near 50 at most."""
    out = [] if out is None else out
    if len(out) >= MAX_DIFFS or a == b:
        return out
    if a[0] != "list" or b[0] != "list":
        out.append((path or "/", f"{a[1] if a[0] != 'list' else 'list'} != {b[1] if b[0] != 'list' else 'list'}"))
        return out
    if len(a[1]) != len(b[1]):
        out.append((path or "/", f"{len(a[1])} items != {len(b[1])} items"))
    for k, (x, y) in enumerate(zip(a[1], b[1])):
        differences(x, y, f"{path}/{k}", out)
    left, right = list(a[2]), list(b[2])
    for key in sorted({k for k, _ in left} | {k for k, _ in right}):
        xs, ys = [v for k, v in left if k == key], [v for k, v in right if k == key]
        if len(xs) != len(ys):
            out.append((f"{path}/{key}", f"{len(xs)} values != {len(ys)} values"))
        for x, y in zip(xs, ys):
            differences(x, y, f"{path}/{key}", out)
    return out


def equivalent(a: str, b: str, ignore: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Differences of two texts; none means equivalent."""
    skip = frozenset(ignore)
    left, right = (("list", tuple(canonical(n, skip) for n in parse(t)[0]), ()) for t in (a, b))
    return differences(left, right)


def n_differences(a: str, b: str) -> Column:
    """A column: how many differences the texts of two columns have."""
    return F.udf(lambda x, y: len(equivalent(x or "", y or "")), IntegerType(), useArrow=True)(a, b)


def link_classes(nodes: DataFrame, schema: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, node_type, status, prefix, candidates): DSL nodes(id, node_type) to classes by reflected name.

    schema(node_type, class_path) gives the class path, whose last part is looked for with the prefixes in order
    among class and struct symbols; the first prefix with a hit wins, definitions are preferred.
    """
    name = F.when(F.contains("class_path", F.lit(".")), F.substring_index("class_path", ".", -1))
    n = nodes.join(schema.select("node_type", name.alias("cls")), "node_type", "left")
    tries = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("prefix")) for k, p in enumerate(PREFIXES)])
    asked = n.where("cls IS NOT NULL").select("id", "cls", F.explode(tries).alias("t")).select("id", "t.ord", "t.prefix", F.concat("t.prefix", "cls").alias("name"))
    # a name's symbols are counted before they meet the nodes, so a join has a row a node and prefix however many share a name
    is_def = (F.col("end_byte") - F.col("start_byte")) > F.length("name") + 16
    code = symbols.where(F.col("kind").isin("class", "struct")).select("name", is_def.alias("_d"))
    tally = code.groupBy("name").agg(F.count("*").alias("n"), F.count_if("_d").alias("n_def"), F.count("_d").alias("n_known"))
    hit = asked.join(tally, "name").groupBy("id", "ord").agg(F.min("prefix").alias("prefix"), *[F.sum(c).alias(c) for c in ("n", "n_def", "n_known")])
    first = hit.groupBy("id").agg(F.min_by(F.struct("prefix", "n", "n_def", "n_known"), "ord").alias("h")).select("id", "h.*")
    kept = F.when(F.col("n") == 1, 1).when(F.col("n_def") > 0, F.col("n_def")).when(F.col("n_known") > 0, F.col("n"))
    best = first.select("id", kept.alias("candidates"), "prefix").where("candidates IS NOT NULL")
    j = n.join(best, "id", "left")
    status = F.when(F.col("cls").isNull(), "no-classPath").when(F.col("candidates").isNull(), "unresolved").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return j.select("id", "node_type", status.alias("status"), "prefix", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def link_summary(links: DataFrame) -> DataFrame:
    """One row of the counts of each status of link_classes and of all."""
    one = {"resolved_unique": "unique", "resolved_ambiguous": "ambiguous", "unresolved": "unresolved", "no_class_path": "no-classPath"}
    return links.agg(*[F.count_if(F.col("status") == status).alias(name) for name, status in one.items()], F.count("*").alias("total"))
