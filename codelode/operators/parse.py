"""Per-file parsing: symbols and named edges of source files, one file in, many rows out.

Python goes through the standard library's syntax tree; brace languages through a tokenizer and brace matching,
S-expression languages through the reader in dsl. A file that does not parse gives one error row.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

from codelode import extensions
from codelode.operators import dsl

# Language by extension.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".inl": "cpp",
    ".cs": "csharp", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".gd": "gdscript", ".glsl": "glsl", ".vert": "glsl", ".frag": "glsl", ".comp": "glsl", ".matlang": "matlang", ".bplisp": "bplisp", ".animlang": "animlang",
}
# Macro names that are no types although they do not look like the rest, and the look of the rest.
EXTRA_MACROS = ("FORCEINLINE", "FORCENOINLINE", "FORCEINLINE_DEBUGGABLE", "CONSTEXPR")
MACRO = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
_HEAD = re.compile(rb"\b(?:class|struct)\b")
_UNIT = re.compile(rb"\s+([A-Za-z_]\w*)(?:\s*\([^()]*\))?")
_BLANK = bytes(b if b == 10 else 32 for b in range(256))  # line ends stay
WORDS = {
    "cpp": {"class": "class", "struct": "struct", "enum": "enum", "namespace": "namespace"},
    "csharp": {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "namespace": "namespace"},
    "java": {"class": "class", "interface": "interface", "enum": "enum"},
    "javascript": {"class": "class"},
    "typescript": {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace"},
    "tsx": {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace"},
    "glsl": {"struct": "struct"},
}
CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof", "using", "lock", "foreach", "function"}
SYMBOLS = "file_id long, tag string, local long, name string, kind string, lang string, start_line long, end_line long, start_byte long, end_byte long, parent_local long, src_local long, dst_name string, dst_local long, relation string, error string"
COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]


def strip_macros(source: str) -> str:
    """Blank the macros between class or struct and the name, so that every byte keeps its place.

    What follows the keyword is read as units, names with their arguments if they have any. All macro units go but
    the last unit, which is the name.
    """
    data = source.encode()
    out = bytearray(data)
    for head in _HEAD.finditer(data):
        units, at = [], head.end()
        while unit := _UNIT.match(data, at):
            units.append(unit)
            at = unit.end()
            name = unit[1].decode()
            if not (MACRO.match(name) or name in EXTRA_MACROS):
                break
        for unit in units[:-1]:
            out[unit.start(1) : unit.end()] = data[unit.start(1) : unit.end()].translate(_BLANK)
    return out.decode()


class Found:
    """Symbols and edges of one file, in order."""

    def __init__(self, lang: str):
        self.lang, self.symbols, self.edges = lang, [], {}

    def symbol(self, name, kind, lines, span, parent):
        self.symbols.append((len(self.symbols), name, kind, *lines, *span, parent))
        if parent is not None:
            self.edges[parent, name, "contains", len(self.symbols) - 1] = None
        return len(self.symbols) - 1

    def edge(self, src, dst, relation):
        """An edge to a name, once; what a symbol contains is an edge to its place."""
        if src is not None and dst:
            self.edges[src, dst, relation, None] = None


def parse_python(source: str) -> Found:
    """Classes, functions and methods with extends, calls, imports and uses_type edges."""
    out, tree = Found("python"), ast.parse(source)
    lines = source.encode().split(b"\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)

    def name_of(node) -> str | None:
        if isinstance(node, ast.Subscript):
            return name_of(node.value)
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def visit(node, parent, in_class):
        for child in ast.iter_child_nodes(node):
            mine, inner = parent, in_class
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                span = (at[child.lineno - 1] + child.col_offset, at[child.end_lineno - 1] + child.end_col_offset)
                mine, inner = out.symbol(child.name, kind, (child.lineno, child.end_lineno), span, parent), is_class
                for base in child.bases if is_class else ():
                    out.edge(mine, name_of(base), "extends")
                if not is_class:
                    for a in (*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs):
                        out.edge(mine, name_of(a.annotation), "uses_type")
                    out.edge(mine, name_of(child.returns), "uses_type")
            elif isinstance(child, ast.Call):
                out.edge(mine, name_of(child.func), "calls")
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out.edge(mine, a.name.split(".")[-1], "imports")
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    out.edge(mine, a.name, "imports")
            elif isinstance(child, ast.AnnAssign):
                out.edge(mine, name_of(child.annotation), "uses_type")
            visit(child, mine, inner)

    visit(tree, None, False)
    return out


_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|=>|::|[^\s]", re.S)


def parse_braces(source: str, lang: str) -> Found:
    """Types and functions of a brace language by their heads and matching braces, with their bases."""
    out = Found(lang)
    toks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(source) if not m[0].startswith(("//", "/*"))]
    prefix = [0]
    for ch in source:
        prefix.append(prefix[-1] + len(ch.encode()))
    words, close, stack = WORDS[lang], {}, []
    for k, (t, _, _) in enumerate(toks):
        if t == "{":
            stack.append(k)
        elif t == "}" and stack:
            close[stack.pop()] = k
    ident = re.compile(r"^[A-Za-z_$][\w$]*$")
    open_at: list[tuple[int, int, str]] = []  # (closing token, symbol, kind)
    k = head = 0
    while k < len(toks):
        t = toks[k][0]
        while open_at and k > open_at[-1][0]:
            open_at.pop()
        if t in (";", "}"):
            head = k + 1
        elif t == "{" and k in close:
            part = toks[head:k]
            parent = open_at[-1][1] if open_at else None
            inside = open_at[-1][2] if open_at else ""
            names = [x[0] for x in part]
            found = None
            word = next((w for w in names if w in words), None)
            if word and "(" not in names[: names.index(word)]:
                after = names[names.index(word) + 1 :]
                if after[:1] == ["class"]:
                    after = after[1:]
                if after and ident.match(after[0]):
                    found = (after[0], words[word], _bases(after[1:], lang))
            elif "(" in names:
                i = names.index("(")
                if i and ident.match(names[i - 1]) and names[i - 1] not in CONTROL:
                    found = (names[i - 1], "method" if inside in ("class", "struct", "interface") else "function", [])
                elif i > 2 and "=" in names[:i] and ("=>" in names or "function" in names):
                    found = (names[names.index("=") - 1], "function", [])
                elif i and names[i - 1] == "function" and "=" in names:
                    found = (names[names.index("=") - 1], "function", [])
            if found:
                a, b = part[0][1], toks[close[k]][2]
                span, rows = (prefix[a], prefix[b]), (source.count("\n", 0, a) + 1, source.count("\n", 0, b) + 1)
                sym = out.symbol(found[0], found[1], rows, span, parent)
                for base, relation in found[2]:
                    out.edge(sym, base, relation)
                open_at.append((close[k], sym, found[1]))
            head = k + 1
        k += 1
    return out


def _bases(tail: list[str], lang: str) -> list[tuple[str, str]]:
    """(name, relation) of what stands after a type's name."""
    out, relation, depth = [], None, 0
    if lang in ("cpp", "csharp"):
        if ":" not in tail:
            return []
        names = [x for x in tail[tail.index(":") + 1 :] if re.match(r"^[A-Za-z_]\w*$", x) and x not in ("public", "private", "protected", "virtual")]
        return [(n, "extends" if lang == "cpp" or not i else "implements") for i, n in enumerate(names)]
    for x in tail:
        depth += (x == "<") - (x == ">")
        if x in ("extends", "implements"):
            relation = x
        elif relation and not depth and re.match(r"^[A-Za-z_$][\w$]*$", x):
            out.append((x, relation))
    return out


def parse_dsl(source: str, lang: str) -> Found:
    """Material, node, graph and outputs forms with the references between nodes."""
    out = Found(lang)
    nodes, _ = dsl.parse(source)

    def visit(items, parent):
        for n in items:
            if n.items is None:
                continue
            mine = parent
            if n.head in ("material", "node", "graph", "outputs"):
                name = n.items[1].text if len(n.items) > 1 and n.items[1].text else n.head
                mine = out.symbol(name, n.head, (n.line, n.line + source.encode()[n.start : n.end].count(b"\n")), (n.start, n.end), parent)
            elif n.head == "ref" and len(n.items) > 1:
                out.edge(parent, n.items[1].text, "ref")
            visit(n.items, mine)

    visit(nodes, None)
    return out


def parse(source: str, lang: str) -> Found:
    if lang == "python":
        return parse_python(source)
    if lang in ("matlang", "bplisp", "animlang"):
        return parse_dsl(source, lang)
    if lang in WORDS:
        return parse_braces(strip_macros(source) if lang == "cpp" else source, lang)
    raise ValueError(f"no parser for {lang}")


def enrich(files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """Tagged rows (symbol, edge or error) of files(id, ext, content); files of other extensions, or of languages not asked for, give none.

    Languages that extensions have added (see extensions.Hooks) come before the engine's own.
    """
    own = {*WORDS, "python", "matlang", "bplisp", "animlang"}
    parsers = {e: (lang, parse) for e, lang in LANGUAGES.items() if lang in own} | extensions.HOOKS.parsers
    parsers = {e: x for e, x in parsers.items() if langs is None or x[0] in langs}

    def run(batches):
        for pdf in batches:
            rows = []
            for i, ext, content in zip(pdf.id, pdf.ext, pdf.content):
                lang, reader = parsers.get((ext or "").lower(), (None, None))
                if lang is None:
                    continue
                try:
                    found = reader(content or "", lang)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((i, "error", *[None] * 13, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(i, "symbol", local, name, kind, lang, *rest, *[None] * 5) for local, name, kind, *rest in found.symbols]
                rows += [(i, "edge", *[None] * 9, src, dst, place, relation, None) for src, dst, relation, place in found.edges]
            out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
            for c in ("file_id", "local", "start_line", "end_line", "start_byte", "end_byte", "parent_local", "src_local", "dst_local"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("id", "ext", "content").mapInPandas(run, SYMBOLS)


def statistics(rows: DataFrame) -> DataFrame:
    """Symbols by language."""
    return rows.where("tag = 'symbol'").groupBy("lang").count()
