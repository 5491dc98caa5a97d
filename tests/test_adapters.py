"""Scans by file and by symbol on small stores, and adapters of one's own."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import adapters, resolve

CODE = {
    "pkg/a.py": "import pkg.b\nfrom pkg.c import C\nimport nowhere\nclass A(Base): pass",
    "pkg/b.py": "from pkg.c import C\nimport pkg.b\nclass B: pass",
    "pkg/c.py": "class C: pass",
    "other/d.py": "import pkg.a\nimport pkg.c\nclass D: pass",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k + 1, path, ".py", text) for k, (path, text) in enumerate(CODE.items())]
    f = spark.createDataFrame(rows, "id long, path string, ext string, content string")
    lines = f.select(F.col("id").alias("file_id"), "path", F.lit("python").alias("lang"), F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    raw = resolve.extract_imports(lines).join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    symbols = spark.createDataFrame([(k + 1, k + 1, path[4].upper() if path.startswith("pkg") else "D", path) for k, path in enumerate(CODE)], "id long, file_id long, name string, path string")
    return adapters.FileAdapter(f, symbols, raw)


def test_by_file(files):
    ask = lambda *a, **k: adapters.scan_from(files, *a, **k)
    out = ask("pkg/a.py")
    assert {(r.id, r.depth) for r in out.nodes.collect()} == {("file:1", 0), ("file:2", 1), ("file:3", 1)}
    assert {(r.src, r.dst, r.relation, r.path, r.line) for r in out.edges.collect()} == {
        ("file:1", "file:2", "imports", "pkg/a.py", 1), ("file:1", "file:3", "imports", "pkg/a.py", 2), ("file:2", "file:3", "imports", "pkg/b.py", 1)
    }
    back = ask("C", direction="in")
    assert {(r.id, r.depth) for r in back.nodes.collect()} == {("file:3", 0), ("file:1", 1), ("file:2", 1), ("file:4", 1)}
    assert ("file:4", "file:3", "other/d.py", 2) in {(r.src, r.dst, r.path, r.line) for r in back.edges.collect()}
    both = ask("b.py", direction="both", max_depth=1)
    assert {r.id for r in both.nodes.collect()} == {"file:1", "file:2", "file:3"} and both.depth_bounded and not both.truncated
    few = ask("pkg/a.py", max_nodes=2)
    assert {r.id for r in few.nodes.collect()} == {"file:1"} and few.truncated and few.elided == 2
    none = ask("zzz")
    assert none.nodes.count() == none.edges.count() == 0 and not none.truncated


def test_importers_are_bounded(spark, files):
    one = adapters.FileAdapter(files.files, files.symbols, files.imports, importers=1)
    assert {r.id for r in adapters.scan_from(one, "pkg/c.py", max_depth=1, direction="in").nodes.collect()} == {"file:3", "file:1"}


def test_by_symbol(spark):
    symbols = spark.createDataFrame(
        [(1, "Foo", "p/x.cpp", "target", 0, 900), (2, "Actor", "e/a.h", "dependency", 0, 900), (3, "Core", "e/c.h", "dependency", 0, 900), (4, "Dup", "e/c.h", "dependency", 0, 900), (5, "Dup", "e/a.h", "dependency", 0, 900)],
        "id long, name string, path string, zone string, start_byte long, end_byte long",
    )
    edges = spark.createDataFrame([(1, 1, 2, "Actor", "extends"), (2, 1, None, "Core", "implements"), (3, 1, None, "Missing", "uses_type"), (4, 1, None, "Dup", "uses_type"), (5, 2, 3, "Core", "extends")], "id long, src_symbol_id long, dst_symbol_id long, dst_name string, relation string")
    got = adapters.scan_from(adapters.SymbolAdapter(edges, symbols), "Foo")
    assert {(r.src, r.dst, r.confidence) for r in got.edges.collect()} == {("s1", "s2", "direct"), ("s1", "s3", "unique"), ("s1", "dep:Missing", "unresolved"), ("s1", "dep:Dup", "ambiguous")}
    assert adapters.scan_from(adapters.SymbolAdapter(edges, symbols), "Actor").nodes.count() == 0  # no target symbol


def test_an_adapter_of_ones_own(spark):
    class Numbers:
        name = "numbers"

        def seeds(self, seed, limit=25):
            return spark.createDataFrame([(seed,)], "id string")

        def neighbours(self, level, direction="out"):
            row = level.select(F.col("id").alias("src"), (F.col("id").cast("long") * 2).cast("string").alias("dst"))
            return row.select("src", "dst", F.lit("twice").alias("relation"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"), F.lit("direct").alias("confidence"), F.lit(False).alias("back"))

    assert isinstance(Numbers(), adapters.Adapter)
    assert {r.id for r in adapters.scan_from(Numbers(), "3", max_depth=3).nodes.collect()} == {"3", "6", "12", "24"}
