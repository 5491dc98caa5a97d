"""Steps whose rows must grow no faster than their input, by what the operators of a run put out."""

from codelode.llm import toxicity
from codelode.operators import dsl, graph, spans


def most_rows(spark, df):
    """(rows, the most rows that any operator put out)."""
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList()
    last = done.apply(done.size() - 1)
    values, metrics = store.executionMetrics(last.executionId()), last.metrics()
    kinds = [metrics.apply(k) for k in range(metrics.size())]
    found = [values.get(m.accumulatorId()) for m in kinds if m.name() == "number of output rows"]
    return rows, max(int(v.get().replace(",", "")) for v in found if v.isDefined())


def test_links_of_a_name_that_many_symbols_share(spark):
    """3000 nodes and 3000 symbols of one name: 9 million pairs, of which only counts are wanted."""
    nodes = spark.range(3000).selectExpr("id", "concat('t', id) AS node_type")
    schema = nodes.selectExpr("node_type", "'/Script/Engine.Part' AS class_path")
    symbols = spark.range(3000).selectExpr("id", "'UPart' AS name", "'class' AS kind", "0L AS start_byte", "id AS end_byte")
    rows, most = most_rows(spark, dsl.link_classes(nodes, schema, symbols))
    assert {(r.status, r.prefix, r.candidates) for r in rows} == {("ambiguous", "U", 3000 - 22)} and len(rows) == 3000
    assert most <= 12000


def test_links_without_known_lengths(spark):
    """Several symbols of unknown length are no definitions and no candidates; one alone is taken; a known one lets all count."""
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "id long, node_type string")
    schema = spark.createDataFrame([("a", "x.A"), ("b", "x.B"), ("c", "x.C"), ("d", "x.A")], "node_type string, class_path string")
    code = [(1, "UA", None), (2, "UA", None), (3, "UB", None), (4, "AC", None), (5, "AC", 3), (6, "FC", 99)]
    symbols = spark.createDataFrame([(i, n, "class", 0, e) for i, n, e in code], "id long, name string, kind string, start_byte long, end_byte long")
    got = sorted((r.id, r.node_type, r.status, r.prefix, r.candidates) for r in dsl.link_classes(nodes, schema, symbols).fillna("-", ["prefix"]).collect())
    assert got == [(1, "a", "unresolved", "-", 0), (2, "b", "unique", "U", 1), (3, "c", "unresolved", "-", 0), (3, "d", "unresolved", "-", 0)]


def test_small_slices_go_together(spark):
    """2000 slices are a few groups, not 2000, and each keeps its own points."""
    made = spark.range(2000).selectExpr("id * 10 AS slice", "explode(array(struct(id * 10 AS src, id * 10 + 1 AS dst), struct(id * 10 + 1 AS src, id * 10 + 2 AS dst), struct(id * 10 + 2 AS src, id * 10 + 1 AS dst))) AS e")
    edges = made.select("slice", "e.*")
    calls = graph.bundled(edges, lambda pdf: pdf[["slice"]].head(1), "slice long", 1000).count()
    assert calls <= 7
    assert sorted(map(tuple, graph.cut_nodes(edges).collect())) == [(k * 10, k * 10 + 1) for k in range(2000)]
    assert sorted(map(tuple, graph.bridges(edges).collect())) == [(k * 10, k * 10, k * 10 + 1) for k in range(2000)]
    comp = sorted(map(tuple, graph.strong_components(edges).where("slice = 70").collect()))
    assert comp == [(70, 70, 70, 1, False), (70, 71, 71, 2, True), (70, 72, 71, 2, True)]
    assert graph.cut_nodes(edges.where("false")).count() == 0


def test_toxicity_hands_the_memory_of_a_fit_back(monkeypatch):
    """Once in the fit, when its tables of words have gone; stems met more than 127 times still count by their number."""
    freed = []
    monkeypatch.setattr(toxicity, "give_back", lambda: freed.append(1))
    texts = ["vile " + " ".join(f"murder{k}" for k in range(20 + 30 * (i % 8))) if i % 2 else "kind talk" for i in range(80)]
    m = toxicity.fit(texts, [i % 2 for i in range(80)])
    assert freed and m.score(texts[15]) >= m.score(texts[1]) > 0.5 > m.score("kind talk")


def test_identifiers_meet_spans_without_being_sent(spark, capsys):
    """Words cross no exchange; crossing spans that change inside a line, words beside digits and marks, and odd lines."""
    text = ["ab 1c _d2é9x", "", "ab.cd-ef gh", "Ünit x"]
    at = [0]
    for line in text:
        at.append(at[-1] + len(line.encode()) + 1)
    lines = spark.createDataFrame([(f, k, line, at[k]) for f in (1, 2) for k, line in enumerate(text)] + [(3, 0, None, 0), (None, 0, "zz", 0)], "file_id long, pos int, line string, start_byte long")
    made = spark.createDataFrame([(1, 7, 1, 20), (1, 8, at[2] + 3, at[2] + 8), (1, 9, at[2] + 6, at[3] + 2), (2, 5, 0, 3), (2, 6, 4, 4)], "file_id long, id long, start_byte long, end_byte long")
    want = spans.innermost(spans.identifiers(lines), made)
    got = spans.placed(lines, made)
    rows = sorted(map(tuple, got.select("file_id", "name", "at", "span_id").collect()), key=repr)
    assert rows == sorted(map(tuple, want.select("file_id", "name", "at", "span_id").collect()), key=repr)
    assert {r[1] for r in rows} == {"ab", "_d2", "cd", "ef", "gh", "nit", "x", "zz"} and {r[3] for r in rows} == {None, 5, 7, 8, 9}
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("MapInArrow") == 1
    assert sorted(map(tuple, spans.identifiers(lines).where("file_id = 2 AND at < 12").collect())) == [(2, "_d2", 6), (2, "ab", 0)]
