"""Operators on small fixtures."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from codelode.functions import paths, text
from codelode.operators import boundary, dsl, graph, parse, refs, render, resolve, rules, search, trace
from codelode.sources import store, tree


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize(
    ("start", "length", "want"),
    [(0, 3, b"h\xc3\xa9"), (1, 1, None), (-5, 1, b"h"), (2, None, None), (0, 99, None), (3, -99, b""), (1, -3, None)],
)
def test_slice_bytes(spark, start, length, want):
    data = "héllo wörld".encode()
    end = len(data) if length is None else max(start, 0) + length
    cut = data[max(start, 0) : end] if want is None else want
    df = spark.createDataFrame([("héllo wörld", start, length)], "c string, s long, n long")
    text.register(spark)
    got = df.select(text.slice_bytes(F.col("c"), F.col("s"), F.col("n")), F.expr("slice_bytes(c, s, n)")).first()
    assert got[0] == got[1] == cut.decode("utf-8", "replace")


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("x/build/y.c",), ("build",)], "path string")
    assert [r[0] for r in df.select(paths.ignored(F.col("path"), ["build"])).collect()] == [False, True, True]
    assert [r[0] for r in df.select(paths.ignored(F.col("path"), ["a/*"])).collect()] == [True, False, False]


def test_search_syntax():
    term = lambda t: ("term", t)
    assert search.parse('one two OR "three four"') == ("or", [("and", [term("one"), term("two")]), term("three four")])
    assert search.parse('a NOT b c AND "OR"') == ("and", [("not", term("a"), ("and", [term("b"), term("c")])), term("OR")])
    assert search.parse('(a OR b*) "say ""so""') == ("and", [("or", [term("a"), term("b")]), term('say "so"')])
    assert search.parse("  ") is search.parse("OR") is search.parse("()") is None and search.parse("OR a )b") == ("and", [term("a"), term("b")])
    assert search.terms_of(search.parse("a b NOT (a OR c)")) == ["a", "b", "c"]


def test_short_terms_match_nothing(spark):
    f = spark.createDataFrame([(1, "p", "ab abc")], "id long, path string, content string")
    assert search.match(f, "ab").count() == 0
    assert search.match(f, "ABC").count() == 1
    assert search.match(f, "abc", search.postings(f)).count() == 1


def test_bfs_takes_whole_levels(spark):
    star = edges(spark, [(0, 1)] + [(1, 10 + k) for k in range(100)])
    s = graph.bfs_bounded(star, seeds(spark, 0), 10, 3)
    assert {r.id for r in s.nodes.collect()} == {0, 1}
    assert (s.truncated, s.frontier_depth, s.elided) == (True, 1, 100)
    assert {(r.id, r.n) for r in s.frontier.collect()} == {(1, 100)}
    chain = edges(spark, [(k, k + 1) for k in range(11)])
    s = graph.bfs_bounded(chain, seeds(spark, 0), 200, 3)
    assert (s.depth_bounded, s.truncated, s.frontier_depth, s.nodes.count()) == (True, False, 3, 4)
    diamond = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert graph.bfs_bounded(diamond, seeds(spark, 0), 4, 3).edges.count() == 4
    assert graph.bfs_bounded(chain, seeds(spark, 0, 1, 2, 3, 4), 3, 3).nodes.count() == 3


def test_components_and_weak_points():
    assert graph.strong_components_of([(1, 2), (2, 1), (1, 3)]) == {1: 1, 2: 1, 3: 3}
    assert len(set(graph.strong_components_of([(k, k + 1) for k in range(5000)]).values())) == 5001
    assert graph.weak_points([(0, 1), (0, 2), (0, 3)]) == ({(0, 1), (0, 2), (0, 3)}, {0})
    assert graph.weak_points([(0, 1), (1, 2), (2, 0)]) == (set(), set())
    assert graph.weak_points([(0, 1), (0, 1), (1, 2)])[0] == {(1, 2)}


def test_layers_leave_cycles(spark):
    done, left = graph.layers(edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4)]))
    assert {(r.id, r.layer) for r in done.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r.id for r in left.collect()} == {4, 5}


def test_confidence(spark):
    symbols = spark.createDataFrame([(1, "A", 0, 1), (2, "Dup", 0, 1), (3, "Dup", 0, 1), (4, "Def", 0, 2000), (5, "Def", 0, 15)], "id long, name string, start_byte long, end_byte long")
    e = spark.createDataFrame([(1, "A", None), (2, "Dup", None), (3, "None", None), (4, "Def", None), (5, "x", 9)], "id long, dst_name string, dst_symbol_id long")
    got = {r.id: (r.confidence, r.ambiguity, r.target_id) for r in resolve.resolve(e, symbols).collect()}
    assert got == {1: ("unique", 1, 1), 2: ("ambiguous", 2, None), 3: ("unresolved", 0, None), 4: ("unique", 1, 4), 5: ("direct", 0, 9)}


def test_module_spec():
    spec = boundary.module_spec([{"name": "A", "include": ["a"]}], ["A=b", "B=c,d"])
    assert spec == [{"name": "A", "include": ["a", "b"], "exclude": []}, {"name": "B", "include": ["c", "d"], "exclude": []}]
    assert boundary.seed_budget(100, 4) == (60, 15)


def test_rules():
    assert rules.validate([{"id": "x", "action": "drop"}]) == []
    assert len(rules.validate([{"id": "x", "action": "no"}, {"id": "x", "action": "reclassify"}])) == 3
    merged = rules.merge([{"id": "b", "action": "drop"}], {"p": {"extends": ["q"], "rules": [{"id": "a"}]}, "q": {"extends": ["p"], "rules": [{"id": "b"}]}}, ["p"])
    assert [(r["id"], r["origin"]) for r in merged] == [("b", "project"), ("a", "p")]


def test_trace_life(spark):
    notes = spark.createDataFrame([(1, 7, "n", "t", "active", 0)], "id long, log_id long, note string, tag string, status string, created_at long")
    out = trace.set_status(notes, [7, 8], "shelved", 5)
    assert {(r.log_id, r.status) for r in out.collect()} == {(7, "shelved"), (8, "shelved")}
    assert trace.tag(notes, 9, "x", "y", 1).count() == 2


def test_symbols_named_without_limit(spark):
    s = spark.range(1203).selectExpr("id", "if(id % 3 = 0, 'b', 'a') AS name", "if(id % 2 = 0, 'class', 'method') AS kind", "'p' AS path")
    assert search.symbols_named(s, "a").count() == 500
    assert search.symbols_named(s, "a", None, None).count() == 802
    assert search.symbols_named(s, "a", ["class"], None).count() == sum(k % 3 > 0 and k % 2 == 0 for k in range(1203))


def test_referenced_paths(spark):
    """Against brute force: several literals a statement, repeats, exact, short, absent and non-ASCII ones."""
    paths = [f"src{k % 7}/doc{k}.en" for k in range(80)] + ["src1/doc", "ab", "Src1/DOC5.en", "\u0391\u0391\u03a3\u0391/x", "src1/doc8.en"]
    lits = [["%doc1%"], ["src1/doc8.en"], ["*doc7.*", "%src0/%"], ["ab"], ["5"], ["%%", ""], ["\u0391\u0391\u03a3"], ["DOC5"], ["none such"], ["doc1", "doc1"], ["src3", "doc3"], ["src1/doc"]]
    log = [(k, "SELECT 1 WHERE " + " OR ".join(f"path LIKE '{x}'" for x in lits[k % len(lits)])) for k in range(600)] + [(3, "path = 'doc9.en'")]
    want = set()
    for k, sql in log:
        for core in (x.strip("%*") for x in re.findall("'([^']*)'", sql)):
            want |= {(k, p) for p in ([core] if core in paths else paths if core else []) if core in p}
    out = search.referenced_paths(spark.createDataFrame(log, "id long, sql_text string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    got = [(r.id, r.path) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    a, b = spark.range(300).selectExpr("id % 3 AS k", "id AS x"), spark.range(200).selectExpr("id % 4 AS k", "id AS y")
    tiles = search.join_in_tiles(a, b, "k", (7, 5)).select("k", "x", "y").collect()
    assert sorted(map(tuple, tiles)) == sorted((x % 3, x, y) for x in range(300) for y in range(200) if x % 3 == y % 4)


def test_referenced_paths_are_written_small(spark, tmp_path):
    """Rows are many times the inputs, so what a row takes on disk must be far less than a byte, where no side is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    log = spark.range(600).selectExpr("id", "concat('x \"%src', id % 2, '/%\"') AS sql_text")
    files = spark.range(18000).selectExpr("concat('src', id % 2, '/en/doc', id * 7919 % 100003, '.en') AS path")
    search.referenced_paths(log, files).write.parquet(str(tmp_path / "out"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (out.count(), out.distinct().count()) == (2 * 300 * 9000, 2 * 300 * 9000)
    assert out.where("id % 2 <> substring(path, 4, 1)").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 2 * 300 * 9000


def test_join_in_tiles_of_several_pieces(spark, monkeypatch):
    """Against a plain join: groups of several lists and pieces, pieces that don't divide evenly, nulls and single rows."""
    monkeypatch.setattr(search, "RUN", (3, 8), raising=False)
    a = spark.range(301).selectExpr("if(id = 300, 7, id % 3) AS k", "if(id = 5, null, id) AS x", "id AS z")
    b = spark.range(203).selectExpr("if(id = 200, 7, id % 4) AS k", "if(id = 9, null, id) AS y")
    got = sorted(map(tuple, search.join_in_tiles(a, b, "k", (13, 29)).select("k", "x", "z", "y").collect()), key=repr)
    assert got == sorted(map(tuple, a.join(b, "k").select("k", "x", "z", "y").collect()), key=repr) and len(got) > 10000


def test_referenced_paths_of_every_statement(spark):
    """Against brute force over all events of the small table, of which the sixty of referenced_paths are a few."""
    from codelode.plans import tables

    known = [r.path for r in tables.views.files(spark, DATA).select("path").collect()]
    want = set()
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect():
        n = r.event_id
        core = (f"src{n % 20}/en", f"doc{n % 900}.", f"src1/en/doc{n % 900}.en")[n % 3]
        want |= {(n, p) for p in known if (p == core if core in known else core in p)}
    got = [(r.id, r.path) for r in tables.referenced_paths_all(spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and max(want)[0] >= 60


def test_refs(spark):
    f = spark.createDataFrame([(1, "a/x.c", "1\n2\n3"), (2, "b/x.c", "q")], "id long, path string, content string")
    assert {r.copy for r in refs.select(f.select("path"), f).collect()} == {"x.c", "b-x.c"}
    spans = spark.createDataFrame([(1, 2, 2, "defined(OTHER)")], "file_id long, first long, last long, condition string")
    assert {r.id: r.content for r in refs.prune(f, spans, ["KEEP"]).collect()} == {1: "1\n3", 2: "q"}
    with pytest.raises(ValueError):
        refs.select(f.select("id"), f)


def test_dsl():
    assert dsl.validate("(material m) (outputs o) (node a x (ref b)) (node b x (ref a))", "matlang")[0][1] == "cycle"
    assert [i[1] for i in dsl.validate("(material m", "matlang")] == ["missing-form", "unclosed-list"]
    assert dsl.equivalent("(a :x 1 :y 1/2)", "(a :y 0.5 :x 1.0) ; same") == []
    assert dsl.equivalent("(a b)", "(a c)") and dsl.equivalent("(a :x 1)", "(a :x 2)", (":x",)) == []


def test_parse_python():
    found = parse.parse_python("class Ä(B):\n    def m(self, x: C) -> D:\n        return f(x)\n")
    assert [(s[1], s[2], s[3], s[4], s[5], s[6]) for s in found.symbols] == [("Ä", "class", 1, 3, 0, 60), ("m", "method", 2, 3, 17, 60)]
    assert {e[:3] for e in found.edges} == {(0, "m", "contains"), (0, "B", "extends"), (1, "C", "uses_type"), (1, "D", "uses_type"), (1, "f", "calls")}


def test_parse_braces_and_macros(spark):
    cpp = "class MY_API Foo : public Bar {\n  void run() { if (x) { y(); } }\n};\nint main(int a) { return 0; }\n"
    assert len(parse.strip_macros(cpp)) == len(cpp) and "MY_API" not in parse.strip_macros(cpp)
    found = parse.parse(cpp, "cpp")
    assert [(s[1], s[2]) for s in found.symbols] == [("Foo", "class"), ("run", "method"), ("main", "function")]
    assert (0, "Bar", "extends", None) in found.edges
    java = parse.parse("class W extends V implements X, Y<Z> { }", "java")
    assert {e[:3] for e in java.edges} == {(0, "V", "extends"), (0, "X", "implements"), (0, "Y", "implements")}
    files = spark.createDataFrame([(1, ".py", "def (:"), (2, ".py", "def f(): pass"), (3, ".md", "x")], "id long, ext string, content string")
    assert {(r.file_id, r.tag) for r in parse.enrich(files).collect()} == {(1, "error"), (2, "symbol")}


def test_render(spark):
    n, e = spark.createDataFrame([("a", "A"), ("b", 'B"x')], "id string, label string"), spark.createDataFrame([("a", "b", "r")], "src string, dst string, relation string")
    for name, f in render.FORMATS.items():
        assert f(n, e) == f(n, e) and "a" in f(n, e), name


def test_store_and_tree(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "sub" / "a.py").write_text("x = 1\n")
    (tmp_path / "t" / "node_modules").mkdir()
    (tmp_path / "t" / "node_modules" / "b.py").write_text("y")
    (tmp_path / "t" / "c.txt").write_bytes(b"\xff")
    files = tree.read_files(spark, str(tmp_path / "t"), exts=[], use_git=False)
    assert [(r.id, r.path, r.content) for r in files.orderBy("id").collect()] == [(1, "c.txt", "\ufffd"), (2, "sub/a.py", "x = 1\n")]
    s = store.Store(spark, str(tmp_path / "store"))
    s.write("files", files)
    assert s.sql("SELECT slice_bytes(content, 0, 1) AS c FROM files WHERE ext = '.py'").first().c == "x"
    assert s.table("edges").count() == 0
    with pytest.raises(ValueError):
        s.sql("DROP TABLE files")


def test_stream(spark, tmp_path):
    from codelode.streaming import feed

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a.py", ".py", 1, 1, "def f(): pass")], "id long, path string, ext string, size long, mtime long, content string").write.parquet(src)
    q = feed.enrich_to(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("tag = 'symbol'").count() == 1
