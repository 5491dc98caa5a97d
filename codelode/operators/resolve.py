"""Name resolution with confidence, parents and qualified names, and import resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import paths


def prefer_definitions(candidates: DataFrame, key: str = "edge_id") -> DataFrame:
    """Of several candidates with some longer than their name by 16 bytes, only those; else all."""
    is_def = (F.col("end_byte") - F.col("start_byte")) > F.length("name") + 16
    w = Window.partitionBy(key)
    marked = candidates.withColumn("_d", is_def).withColumn("_n", F.count("*").over(w)).withColumn("_any", F.max("_d").over(w))
    return marked.where("_n = 1 OR NOT _any OR _d").drop("_d", "_n", "_any")


def definitions(symbols: DataFrame) -> DataFrame:
    """The symbols of each name that stand as its candidates; decided once a name, not once an edge."""
    long = (F.col("end_byte") - F.col("start_byte")) > F.length("name") + 16
    per = symbols.groupBy("name").agg(F.count("*").alias("_n"), F.max(long).alias("_any"))
    return symbols.join(per, "name").where((F.col("_n") == 1) | ~F.col("_any") | long).drop("_n", "_any")


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with confidence, ambiguity (number of candidates) and target id (null unless direct or unique)."""
    per = definitions(symbols).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    j = edges.join(per, edges.dst_name == per.name, "left")
    n = F.coalesce("n", F.lit(0))
    direct = F.col("dst_symbol_id").isNotNull() if "dst_symbol_id" in edges.columns else F.lit(False)
    confidence = F.when(direct, "direct").when(n == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous")
    known = F.col("dst_symbol_id") if "dst_symbol_id" in edges.columns else F.lit(None).cast("long")
    return j.select(*[edges[c] for c in edges.columns if c != "dst_symbol_id"], confidence.alias("confidence"), n.alias("ambiguity"), F.coalesce(known, F.when(n == 1, F.col("only"))).alias("target_id"))


def qualified_names(symbols: DataFrame, depth: int = 32) -> DataFrame:
    """(id, qualified): names joined by :: from the outermost parent; stops at a repeated id or at depth."""
    base = symbols.select("id", "name", "parent_id")
    up = base.select(F.col("id").alias("_p"), F.col("name").alias("_pn"), F.col("parent_id").alias("_pp"))
    cur = base.select("id", F.col("name").alias("qualified"), F.col("parent_id").alias("at"), F.array("id").alias("seen"))
    done = cur.where("at IS NULL")
    cur = cur.where("at IS NOT NULL")
    for _ in range(depth):
        step = cur.join(up, cur.at == up._p, "left")
        loop = F.array_contains("seen", F.col("_p"))
        step = step.select("id", F.when(F.col("_pn").isNull() | loop, F.col("qualified")).otherwise(F.concat("_pn", F.lit("::"), "qualified")).alias("qualified"), F.when(~F.coalesce(loop, F.lit(True)), F.col("_pp")).alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        done = done.unionByName(step.where("at IS NULL"))
        cur = step.where("at IS NOT NULL")
        if not cur.take(1):
            break
    return done.unionByName(cur).select("id", "qualified")


def extract_imports(code: DataFrame) -> DataFrame:
    """(file_id, line, kind, target) of code(file_id, lang, pos, line): Python, C family, C# and JavaScript imports."""
    line, lang = F.col("line"), F.col("lang")
    py_from = F.regexp_extract(line, r"^\s*from\s+([.\w]+)\s+import\b", 1)
    py_list = F.regexp_extract(line, r"^\s*import\s+([^#]+)", 1)
    py = F.when(py_from != "", F.array(py_from)).when(py_list != "", F.transform(F.split(py_list, ","), lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+.*$|\s.*$", ""))).otherwise(F.array().cast("array<string>"))
    inc = F.regexp_extract(line, r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    using = F.regexp_extract(line, r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", 1)
    js = F.concat(F.regexp_extract_all(line, F.lit(r"""\bfrom\s+['"]([^'"]+)['"]"""), 1), F.regexp_extract_all(line, F.lit(r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""), 1), F.regexp_extract_all(line, F.lit(r"""^\s*import\s+['"]([^'"]+)['"]"""), 1))
    found = F.when(lang == "python", py).when(lang.isin("c", "cpp"), F.array(inc)).when(lang == "csharp", F.array(using)).when(lang.isin("javascript", "typescript", "tsx"), js).otherwise(F.array().cast("array<string>"))
    kind = F.when((lang == "python") & (py_from != ""), "import_from").when(lang == "python", "import").when(lang.isin("c", "cpp"), "include").when(lang == "csharp", "using").otherwise("js")
    return code.select("file_id", (F.col("pos") + 1).alias("line"), kind.alias("kind"), F.explode(found).alias("target")).where("target <> ''")


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports(file_id, path, kind, target) with one row per candidate path, in order of preference."""
    dotted = F.translate("target", ".", "/")
    up = F.length(F.regexp_extract("target", r"^\.*", 0))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rel = F.concat_ws("/", F.when(folder != "", folder), F.when(F.regexp_replace("target", r"^\.+", "") != "", F.translate(F.regexp_replace("target", r"^\.+", ""), ".", "/")))
    py = F.when(up > 0, F.array(F.concat(rel, F.lit(".py")), F.concat(rel, F.lit("/__init__.py")))).otherwise(F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
    js_base = F.when(F.startswith("target", F.lit(".")), F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace("target", r"^\./", ""))).otherwise(F.col("target"))
    js = F.transform(F.array(*map(F.lit, ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"))), lambda e: F.concat(js_base, e))
    inc = F.array(F.concat_ws("/", F.when(folder != "", folder), F.col("target")), F.col("target"))
    cs = F.array(F.concat(dotted, F.lit(".cs")))
    cand = F.when(F.col("kind").isin("import", "import_from"), py).when(F.col("kind") == "js", js).when(F.col("kind") == "include", inc).otherwise(cs)
    return imports.select("*", F.posexplode(cand).alias("ord", "cand"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line, target, dst_file_id): exact path, then path suffix, then base name; shortest path, smallest id."""
    cand = import_candidates(imports).withColumn("cand", paths.normalise(F.col("cand"))).withColumn("base", paths.base_name(F.col("cand")))
    index = files.select(F.col("id").alias("dst_file_id"), F.col("path").alias("dst_path")).withColumn("base", paths.base_name(F.col("dst_path")))
    hit = cand.join(index, "base")
    stage = F.when(F.col("dst_path") == F.col("cand"), 1).when(F.endswith("dst_path", F.concat(F.lit("/"), "cand")), 2).otherwise(3)
    first = F.min_by(F.col("dst_file_id"), F.struct(stage, F.when(stage == 3, F.lit(0)).otherwise(F.col("ord")), F.length("dst_path"), "dst_path", "dst_file_id"))
    best = hit.groupBy("file_id", "line", "target").agg(first.alias("dst_file_id"))
    return imports.select("file_id", "line", "target").distinct().join(best, ["file_id", "line", "target"], "left")


def by_id(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of many ids at once, as one semi-join on wanted(id)."""
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def files_in_order(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Files by path, of the given extensions in any case."""
    rows = files.where(F.lower("ext").isin([e.lower() for e in exts])) if exts else files
    return rows.orderBy("path")
