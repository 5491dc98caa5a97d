"""Order, bands, quotients, rules documents and where stores are."""

import json
from collections import deque

import pytest
from pyspark.sql import functions as F

from codelode.operators import boundary, dsl, graph, rules
from codelode.sources import catalog


def test_topological_order(spark):
    pairs = [(1, 9), (1, 4), (2, 4), (4, 3), (9, 3), (9, 8), (2, 2), (5, 6), (6, 5), (6, 7), (3, 10), (2, 8), (1, 9)]
    ahead = {b: {a for a, x in pairs if x == b and a != b} for p in pairs for b in p}
    left = {n: len(a) for n, a in ahead.items()}
    queue, want = deque(sorted(n for n, k in left.items() if not k)), []
    while queue:
        want.append(queue.popleft())
        for n in sorted(n for n, a in ahead.items() if want[-1] in a):
            left[n] -= 1
            if not left[n]:
                queue.append(n)
    e = spark.createDataFrame(pairs, "src long, dst long")
    order, rest = graph.topological_order(e)
    assert [r.id for r in order.orderBy("place").collect()] == want and sorted(r.place for r in order.collect()) == list(range(1, len(want) + 1))
    assert sorted(r.id for r in rest.collect()) == [5, 6, 7]
    order, rest = graph.topological_order(e.where("false"))
    assert order.count() == rest.count() == 0


def test_bands_and_super_nodes(spark):
    n = spark.createDataFrame(
        [(1, "a/x.tar.gz", "target", "A"), (2, "a/.hidden", "target", "Z"), (3, None, "target", None), (4, "lib/y.h", "dependency", "B"), (5, "", "dependency", "External")], "id long, path string, zone string, module string"
    )
    got = {r.id: r.band for r in boundary.module_bands(n, ["B", "Empty", "A"]).collect()}
    assert got == {4: 0, 1: 1, 5: 2, 2: 3, 3: 3}
    of, folded = boundary.super_nodes(boundary.two_bands(n), F.lit("lib"))
    assert {r.id: r.grp for r in of.collect()} == {1: "target:x.tar", 2: "target:.hidden", 3: "target:(external)", 4: "dependency:lib", 5: "dependency:(external)"}
    assert {r.band for r in folded.where("side = 'target'").collect()} == {0}
    assert {r.grp for r in boundary.super_nodes(boundary.flat_bands(n), F.lit("lib"), "dir")[1].where("side = 'target'").collect()} == {"target:a", "target:(external)"}
    with pytest.raises(ValueError):
        boundary.super_nodes(n, F.lit("lib"), "deep")


def test_quotient(spark):
    groups = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "id long, grp string")
    e = spark.createDataFrame([(1, 2, False, True), (1, 3, False, False), (2, 3, True, False), (3, 4, False, True)], "src long, dst long, cross boolean, bridge boolean")
    rows = lambda q: sorted(tuple(r) for r in q.collect())
    assert rows(boundary.quotient(e, groups)) == [("A", "B", 2, True, False), ("B", "4", 1, False, True)]
    assert rows(boundary.quotient(e, groups, groups.where("grp = 'B'"))) == [("1", "2", 1, False, True), ("1", "B", 1, False, False), ("2", "B", 1, True, False), ("B", "4", 1, False, True)]


def test_link_summary(spark):
    links = spark.createDataFrame([("unique",), ("unique",), ("unresolved",), ("no-classPath",)], "status string")
    assert tuple(dsl.link_summary(links).first()) == (2, 0, 1, 1, 4)
    assert tuple(dsl.link_summary(links.where("false")).first()) == (0, 0, 0, 0, 0)


def test_rules_documents(tmp_path):
    def put(name, **doc):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc))

    put("p/base.rules.json", extends_presets=["round"], preset_dirs=["."], rules=[{"id": "a", "action": "drop"}, {"id": "b", "action": "drop"}])
    put("p/round.rules.json", extends_presets=["base"], preset_dirs=["."], rules=[{"id": "r", "action": "drop"}])
    put("rules.json", extends_presets=["base"], preset_dirs=["p"], rules=[{"id": "c"}, {"id": "a", "action": "set_attr"}, {"id": "c", "kind_to": "x"}])
    got = rules.load(str(tmp_path / "rules.json"))
    assert [(r.get("id"), r["_origin"]) for r in got] == [("r", "preset:round"), ("a", "project"), ("b", "preset:base"), ("c", "project")]
    assert got[1]["action"] == "set_attr" and got[3]["kind_to"] == "x"
    assert rules.load(str(tmp_path / "none.json")) == []
    put("bad.json", extends_presets=["nowhere"])
    with pytest.raises(ValueError):
        rules.load(str(tmp_path / "bad.json"))


def test_store_places(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(catalog.VARIABLE, raising=False)
    root = tmp_path / "work"
    (root / "deep" / "er").mkdir(parents=True)
    at = catalog.init(spark, str(root), languages=["python", "Java"])
    assert catalog.init(spark, str(root), languages=["cpp"]) == at and catalog.is_store(spark, at)
    assert catalog.nearest(spark, str(root / "deep" / "er")) == catalog.nearest(spark, at) == at
    assert catalog.nearest(spark, str(tmp_path)) is None
    said = catalog.settings(spark, at)
    assert (said["alias"], said["exts"], said["ignore"]) == ("work", [".py", ".pyi", ".java"], list(catalog.IGNORE))
    catalog.put(spark, at, "user", alias="mine", exts=[".x"], ignore=[])
    catalog.put(spark, at, "shared", alias="theirs")
    said = catalog.settings(spark, at)
    assert (said["alias"], said["exts"], said["ignore"], said["languages"]) == ("mine", [".x"], [], ["python", "Java"])
    catalog.put(spark, at, "user", alias=None)
    assert catalog.settings(spark, at)["alias"] == "theirs"
    with pytest.raises(ValueError):
        catalog.put(spark, at, "other", alias="x")
    assert catalog.active_extensions(spark, at, {"engine": "*.proj"}) == []
    (root / "a.proj").write_text("")
    assert catalog.active_extensions(spark, at, {"engine": "*.proj"}) == ["engine"]
    catalog.put(spark, at, profile="other")
    assert catalog.active_extensions(spark, at, {"engine": "*.proj", "other": "*.none"}) == ["other"]
    catalog.put(spark, at, extensions=[])
    assert catalog.active_extensions(spark, at, {"engine": "*.proj"}) == []


def test_catalog(spark, tmp_path, monkeypatch):
    """The newest row of a store counts; aliases, folders and the environment lead to it."""
    monkeypatch.delenv(catalog.VARIABLE, raising=False)
    one, two = (catalog.init(spark, str(tmp_path / x)) for x in ("one", "two"))
    c = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert c.stores().count() == 0 and not c.remove(one)
    c.add(one)
    c.add(two, "both")
    c.add(one, "both", "elsewhere")
    assert {(r.store, r.alias, r.root) for r in c.stores().collect()} == {(one, "both", "elsewhere"), (two, "both", two.rpartition("/")[0])}
    assert c.named("both") == one == catalog.resolve(spark, "both", catalog=c) and c.named("one") is None
    assert c.remove(one) and not c.remove(one) and c.named("both") == two
    assert catalog.resolve(spark, one) == catalog.resolve(spark, str(tmp_path / "one")) == catalog.resolve(spark, start=str(tmp_path / "one")) == one
    monkeypatch.setenv(catalog.VARIABLE, two)
    assert catalog.resolve(spark, start=str(tmp_path / "one")) == two
    monkeypatch.setenv(catalog.VARIABLE, str(tmp_path / "gone"))
    for name in (None, "nobody"):
        with pytest.raises(catalog.NoStore):
            catalog.resolve(spark, name, catalog=c)


def test_unsuitable_places(tmp_path):
    assert all(catalog.unsuitable(str(p), str(tmp_path)) for p in ("/", tmp_path, tmp_path / "Desktop"))
    assert not catalog.unsuitable(str(tmp_path / "work"), str(tmp_path))


def test_file_state(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("four")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "empty").write_text("")
    names = spark.createDataFrame([(1, "a/b.txt"), (1, "none"), (2, "c.txt"), (2, "empty"), (3, None)], "id long, path string")
    got = {(r.id, r.path): (r.mtime, r["size"]) for r in catalog.file_state(spark, names, str(tmp_path)).collect()}
    assert got == {(1, "a/b.txt"): (int((tmp_path / "a" / "b.txt").stat().st_mtime), 4), (1, "none"): (None, None), (2, "c.txt"): (int((tmp_path / "c.txt").stat().st_mtime), 1), (2, "empty"): (None, None), (3, None): (None, None)}
