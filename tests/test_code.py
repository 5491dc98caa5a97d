"""From a source tree to tables, builds, documents and the store's dialect."""

import json

import pytest
from pyspark.sql import functions as F

from codelode.operators import assemble, boundary, dsl, graph, parse, render, scan
from codelode.sources import dialect, store, tree

TREE = {
    "game/core/package.json": "{}",
    "game/core/a.py": "class Base:\n    def go(self): pass\nclass Own(Base):\n    x: Engine\n    def run(self, e: Engine, l: Lost) -> Own: pass\n",
    "lib/engine.py": "class Engine(Root):\n    pass\nclass Root:\n    pass\n",
    "lib/two.py": "class Twin:\n    pass\n",
    "game/b.py": "class Twin:\n    pass\nclass User(Twin):\n    m: MY_GAME_API\n",
    "bad.py": "def (:",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, body in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / ".codelode").mkdir()
    (root / ".codelode" / "kept.py").write_text("x = 1")
    s = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.write("files", tree.read_files(spark, str(root), use_git=False))
    errors = assemble.enrich_store(s)
    return s, errors


def test_tree_to_tables(built):
    s, errors = built
    assert {r.path for r in s.table("files").collect()} == set(TREE)
    assert errors.count() == 1
    names = {r.id: r.name for r in s.table("symbols").collect()}
    parents = {names[r.id]: names.get(r.parent_id) for r in s.table("symbols").collect() if r.name in ("go", "run", "Base")}
    assert parents == {"go": "Base", "run": "Own", "Base": None}
    edges = {(names[r.src_symbol_id], r.relation, r.dst_name, names.get(r.dst_symbol_id)) for r in s.table("edges").collect()}
    assert ("Own", "extends", "Base", "Base") in edges and ("Own", "uses_type", "Engine", None) in edges
    assert dict(map(tuple, s.table("meta").collect())) == {"enrich.symbols": str(len(names)), "enrich.edges": str(s.table("edges").count())}


def test_dropped_symbols(spark):
    rows = spark.createDataFrame([(1, 0, "A", "class", "cpp", None), (1, 2, "f", "function", "cpp", 1), (1, 3, "B", "class", "cpp", 0)], "file_id long, local long, name string, kind string, lang string, parent_local long")
    e = spark.createDataFrame([(1, 0, None, "B", "extends"), (1, 1, None, "B", "calls"), (1, 3, 1, "x", "calls"), (1, 3, 0, "A", "calls"), (1, 2, None, "f", "calls")], "file_id long, src_local long, dst_local long, dst_name string, relation string")
    k = assemble.SPAN
    assert {r.name: r.parent_id for r in assemble.symbols(rows).collect()} == {"A": None, "f": None, "B": k}
    assert {(r.src_symbol_id - k, r.dst_symbol_id and r.dst_symbol_id - k, r.relation) for r in assemble.edges(e, rows).collect()} == {(0, 3, "extends"), (3, 0, "calls"), (2, None, "calls")}


def _parts(s, root):
    files = s.table("files").select(F.col("id").alias("file_id"), "path")
    return s.table("edges"), boundary.zones(s.table("symbols").join(files, "file_id"), root)


def test_boundary_build(built):
    s, _ = built
    edges, symbols = _parts(s, "game")
    names = {f"s{r.id}": r.name for r in s.table("symbols").collect()}
    b = scan.boundary_build(edges, symbols)
    got = {(names.get(r.src), names.get(r.dst, r.dst), r.relation, r.confidence) for r in b.edges.collect()}
    assert {("Own", "Base", "extends", "direct"), ("Own", "Engine", "uses_type", "unique"), ("run", "dep:Lost", "uses_type", "unresolved"), ("User", "Twin", "extends", "direct")} <= got
    assert not any("API" in str(x) for x in got) and not b.truncated
    zone = {names.get(r.id, r.id): (r.zone, r.depth) for r in b.nodes.collect()}
    assert zone["Engine"] == ("dependency", 1) and zone["dep:Lost"] == ("dependency", 1) and zone["Own"] == ("target", 0) and "Root" not in zone
    deep = {names.get(r.id, r.id): r.depth for r in scan.boundary_build(edges, symbols, dep_depth=2).nodes.collect()}
    assert deep["Root"] == 2
    few = scan.boundary_build(edges, symbols, max_nodes=3)
    assert few.nodes.count() == 3 and few.truncated and few.elided > 0
    assert [names[f"s{r.id}"] for r in scan.symbol_seeds(symbols, "Own").collect()] == ["Own"] and scan.symbol_seeds(symbols, "Engine").count() == 0


def test_modules_build(built):
    s, _ = built
    files = s.table("files").select(F.col("id").alias("file_id"), "path")
    symbols = boundary.modules(s.table("symbols").join(files, "file_id"), [{"name": "Game", "include": ["game"]}, {"name": "Lib", "include": ["lib/engine.py"]}]).drop("prefix")
    names = {f"s{r.id}": r.name for r in s.table("symbols").collect()}
    order = ["Game", "Lib"]
    b = scan.modules_build(s.table("edges"), symbols, order)
    assert {r.module for r in b.nodes.collect()} == {"Game", "Lib", "External"}
    assert ("Own", "Engine", "unique") in {(names.get(r.src), names.get(r.dst), r.confidence) for r in b.edges.collect()}
    # a seed a module; what they lead to is one more node, so nothing is left out
    few = scan.modules_build(s.table("edges"), symbols, order, max_nodes=4)
    assert few.nodes.count() == 3 and not few.truncated
    less = scan.modules_build(s.table("edges"), symbols, order, max_nodes=2)
    assert less.nodes.count() == 2 and less.truncated and less.elided > 0
    free = s.table("edges").drop("dst_symbol_id")
    assert ("User", "amb:Twin", "ambiguous") in {(names.get(r.src), names.get(r.dst, r.dst), r.confidence) for r in scan.modules_build(free, symbols, order).edges.collect()}


def test_modules_are_dealt_as_declared(spark):
    """With room for one target only, the one that the module declared first leads to is taken."""
    symbols = [(1, "S1", "z/one.h", "Z"), (2, "S2", "a/two.h", "A"), (3, "T1", "x/t.h", "External"), (4, "T2", "x/u.h", "External")]
    symbols = spark.createDataFrame([(*s, 0, 100) for s in symbols], "id long, name string, path string, module string, start_byte long, end_byte long")
    edges = spark.createDataFrame([(1, 1, "T2", "extends"), (2, 2, "T1", "extends")], "id long, src_symbol_id long, dst_name string, relation string")
    for order, want in ((["Z", "A"], "s4"), (["A", "Z"], "s3")):
        b = scan.modules_build(edges, symbols, order, max_nodes=3)
        assert {r.id for r in b.nodes.collect()} == {"s1", "s2", want} and b.elided == 1


def test_members_are_edges_by_place(spark):
    """Two classes with a method of one name have an edge each to their own."""
    files = spark.createDataFrame([(1, ".py", "class A:\n    def go(self): pass\nclass B:\n    def go(self): pass\n"), (2, ".java", "class C { void go() { } }")], "id long, ext string, content string")
    rows = parse.enrich(files)
    made = rows.where("tag = 'symbol'")
    got = assemble.edges(rows.where("tag = 'edge'").select("file_id", "src_local", "dst_local", "dst_name", "relation"), made)
    k = assemble.SPAN
    assert {(r.src_symbol_id, r.dst_symbol_id) for r in got.where("relation = 'contains'").collect()} == {(k, k + 1), (k + 2, k + 3), (2 * k, 2 * k + 1)}


def test_guard_reads_classes_not_text(built):
    s, _ = built
    assert [tuple(r) for r in s.query("SELECT 'a\nSet x', 'b\nInsertInto y'").collect()] == [("a\nSet x", "b\nInsertInto y")]
    for bad in ("CREATE VIEW v AS SELECT 1", "CACHE TABLE files", "EXPLAIN SELECT 1", "TRUNCATE TABLE files", "BEGIN SELECT 1; END", "WITH a AS (SELECT 1) INSERT INTO files TABLE a"):
        with pytest.raises(ValueError):
            s.sql(bad)


def test_long_chain(spark):
    """A chain of 1000 nodes: components, strong components and bridges in slices, and the budget that refuses it."""
    e = spark.range(999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.weak_components(e).where("component = 0").count() == 1000
    cut = graph.slices(e)
    assert graph.bridges(cut).count() == 999 and graph.cut_nodes(cut).count() == 998
    with pytest.raises(graph.SliceTooLarge):
        graph.slices(e, budget=100)


def test_macros_and_flags():
    many = "".join(f"class A_API X{k} {{ }};\n" for k in range(80))
    assert "A_API" not in parse.strip_macros(many)
    assert [x[1] for x in parse.parse("class FORCEINLINE Foo { };", "cpp").symbols] == ["Foo"]
    twice = "class A_API B_API(é) Foo { };"
    assert len(parse.strip_macros(twice).encode()) == len(twice.encode()) and "API" not in parse.strip_macros(twice)
    same = lambda text: parse.strip_macros(text) == text
    assert same("class Foo : A_API Bar { };") and same("class A_API { };") and same("struct X_Y(1)Z {") and same("class A_API(f(1)) Foo")
    assert parse.strip_macros("class A_API\n\tB_C (x)  Foo") == "class " + " " * 5 + "\n\t" + " " * 7 + "  Foo"
    assert dsl.equivalent("(n :flag :a 1)", "(n :a 1 :flag)") == [] and dsl.equivalent("(n :flag)", "(n :flag 1)")


def test_dialect(built):
    s, _ = built
    one = lambda q: [tuple(r) for r in s.query(q).collect()]
    assert one("SELECT count(*) FROM symbols WHERE name LIKE 'BASE' AND name <> 'LIKE'") == [(1,)]
    assert one("SELECT path FROM files WHERE path GLOB 'lib/*.py' ORDER BY path") == [("lib/engine.py",), ("lib/two.py",)]
    assert one("SELECT group_concat(name, '|') FROM (SELECT name FROM symbols WHERE name = 'Root')") == [("Root",)]
    assert one("SELECT group_concat(DISTINCT kind) FROM symbols WHERE name = 'Twin'") == [("class",)]
    assert one("SELECT f.path FROM files_fts JOIN files f ON f.rowid = files_fts.rowid WHERE files_fts MATCH '\"class engine\"'") == [("lib/engine.py",)]
    assert one("SELECT CAST('x1' AS INTEGER) IS NULL, json_extract('{\"a\": 5}', '$.a'), strftime('%Y-%m', '2024-05-06')") == [(True, "5", "2024-05")]
    assert one("SELECT [name] FROM \"symbols\" WHERE name = 'it''s' -- LIKE here") == []
    assert len(one("SELECT datetime('now')")[0][0]) == 19
    assert one("SELECT total(size) FROM files WHERE size < 0") == [(0.0,)]
    assert one("SELECT path FROM files_fts WHERE files_fts MATCH 'class NOT engine' AND path LIKE 'lib/%'") == [("lib/two.py",)]
    assert one("SELECT path FROM files_fts WHERE content MATCH 'engine' OR path MATCH 'two'  ORDER BY path") == [("game/core/a.py",), ("lib/engine.py",), ("lib/two.py",)]
    assert one('SELECT f."path" AS "the path" FROM files f WHERE path = "lib/two.py"') == [("lib/two.py",)]
    seen = []
    s.query("SELECT 1", seen.append)
    assert seen == ["SELECT 1"]
    for bad in ("WITH a AS (SELECT 1) INSERT INTO files SELECT * FROM a", "FROM files INSERT INTO files SELECT *", "DROP TABLE files", "SET x=1"):
        with pytest.raises(ValueError):
            s.query(bad)


def test_store_copy_cache_and_reading(spark, built, tmp_path):
    s, _ = built
    other = store.Store(spark, str(tmp_path / "other"))
    other.copy_from(s)
    assert other.fingerprint() == s.fingerprint()
    calls = []
    make = lambda: calls.append(1) or (spark.range(3), spark.range(2))
    assert [x.count() for x in other.cached_slice("k", make)] == [x.count() for x in other.cached_slice("k", make)] == [3, 2] and calls == [1]
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "none"), read_only=True)
    with pytest.raises(PermissionError):
        store.Store(spark, str(tmp_path / "other"), read_only=True).write("files", s.table("files"))


def test_documents(spark):
    n = spark.createDataFrame([(1, 'A"x\ny', "M"), (2, "B", "N")], "id long, label string, module string")
    e = spark.createDataFrame([(1, 2, "r", 3), (2, 1, "r", 1)], "src long, dst long, relation string, weight long")
    assert render.to_mermaid(n, e, {1: 4}, True, 2, 7) == "flowchart TD\n  %% truncated at level 2: 7 deps elided\n  n_1[\"A'x y +4⤳\"]\n  n_2[\"B\"]\n  n_1 -->|r| n_2\n  n_2 -->|r| n_1\n"
    assert render.to_dot(n, e, {2: 1}).split("\n")[2:5] == ["  \"1\" [label=\"A'x y\"];", '  "2" [label="B (+1)"];', '  "1" -> "2" [label="r"];']
    assert json.loads(render.to_json(n, e))["edges"][0] == {"dst": 2, "relation": "r", "src": 1, "weight": 3}
    cut = graph.slices(e)
    comp = graph.strong_components(cut)
    layers, left = graph.layers(e)
    summary = graph.metrics(n, e, comp)
    m = json.loads(render.metrics_json(summary, graph.coupling(n, e), comp, graph.bridges(cut), graph.cut_nodes(cut), layers, left))
    assert m["summary"]["cycles"] == 1 and m["cycles"] == [[1, 2]] and m["bridges"] == [] and m["leftover"] == [1, 2]
    assert render.metrics_text(summary, graph.coupling(n, e)).startswith("nodes: 2\n")
    fans, cycles = boundary.fan_stats(e, n), graph.strong_components(graph.slices(e))
    doc = json.loads(render.modules_json(boundary.matrix(e, n), boundary.matrix_by_relation(e, n), fans, boundary.needed(e, n), boundary.cut_costs(e, n), cycles, ["M", "N"]))
    assert [x["weight"] for x in doc["matrix"]] == [3, 1] and doc["cycles"] == [[1, 2]] and doc["needed"][0]["symbols"][0]["label"] == "B"
    with pytest.raises(ValueError):
        render.take(n, F.col("label"), ["id"], 1)
    assert render.tsv(n.select("id", "label"), ["id"]) == 'id\tlabel\n1\tA"x y\n2\tB\n'
