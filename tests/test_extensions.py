"""Languages, passes and adapters added by other modules; logged statements; the extensions a tree is read by."""

import sys
import types
from concurrent.futures import ThreadPoolExecutor

import pytest

from codelode import extensions
from codelode.operators import assemble, parse
from codelode.sources import store, tree


@pytest.fixture
def plugin(monkeypatch):
    calls = []

    def read(source, lang):
        found = parse.Found(lang)
        for k, line in enumerate(source.split("\n")):
            if line.startswith("def "):
                found.symbol(line[4:], "function", (k + 1, k + 1), (0, 1), None)
        return found

    def register(hooks):
        calls.append(1)
        hooks.language("toy", [".TOY"], read)
        hooks.validation("toy", check)
        hooks.validation("toy", check)
        hooks.adapter("toy", lambda s: s)

    def check(source):
        return []

    module = types.ModuleType("toy_plugin")
    module.register = register
    monkeypatch.setitem(sys.modules, "toy_plugin", module)
    yield calls
    extensions.reset()


def test_registry(spark, plugin):
    files = spark.createDataFrame([(1, ".toy", "def one\nx\ndef two"), (2, ".py", "class A: pass")], "id long, ext string, content string")
    assert {r.name for r in parse.enrich(files).collect()} == {"A"}
    assert extensions.discover(["toy_plugin", "toy_plugin"]) == ["toy_plugin"] and extensions.discover(["toy_plugin"]) == [] and len(plugin) == 1
    assert len(extensions.HOOKS.passes["toy"]) == 1 and list(extensions.HOOKS.adapters) == ["toy"]
    assert {(r.name, r.lang) for r in parse.enrich(files).collect()} == {("A", "python"), ("one", "toy"), ("two", "toy")}
    assert {r.name for r in parse.enrich(files, ["toy"]).collect()} == {"one", "two"}
    extensions.reset()
    assert {r.name for r in parse.enrich(files).collect()} == {"A"} and extensions.discover(["toy_plugin"]) == ["toy_plugin"]
    with pytest.raises(ModuleNotFoundError):
        extensions.discover(["no_such_plugin"])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"src/a.py": "class A: pass", "src/b.py": "class B: pass", "notes.txt": "x", "doc.MD": "y", "pkg.json": "{}"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    s = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.write("files", tree.read_files(spark, str(root), use_git=False))
    return s, root


def test_tree_extensions(spark, small):
    s, root = small
    assert {r.path for r in s.table("files").collect()} == {"src/a.py", "src/b.py", "doc.MD", "pkg.json"}
    assert tree.read_files(spark, str(root), exts=[], use_git=False).count() == 5
    assert {r.path for r in tree.read_files(spark, str(root), exts=[".TXT"], use_git=False).collect()} == {"notes.txt"}
    assemble.enrich_store(s, langs=["java"])
    assert s.table("symbols").count() == 0


def test_logged(small):
    s, root = small
    assert s.logged("SELECT count(*) AS n FROM files WHERE path = \"src/a.py\" OR path = 'src/b.py'", "p", task_tag="t", root=str(root)).columns == ["n"]
    (root / "src" / "b.py").unlink()
    s.logged("SELECT path FROM files WHERE path LIKE '%b.py'", root=str(root))
    s.logged("SELECT 1", kind="static")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: s.logged(f"SELECT {k}"), range(4)))
    rows = s.table("query_log").orderBy("id").collect()
    assert len(rows) == 7 and len({r.id for r in rows}) == 7
    first, second, third = rows[:3]
    assert [(f.path, f["size"]) for f in first.file_state] == [("src/a.py", 13), ("src/b.py", 13)] and (first.project, first.task_tag, first.kind) == ("p", "t", "dynamic") and len(first.valid_date) == 10
    assert [tuple(f) for f in second.file_state] == [("src/b.py", None, None)]
    assert (third.valid_date, third.file_state, third.kind) == (None, None, "static") and rows[3].file_state == []
    with pytest.raises(ValueError):
        s.logged("DROP TABLE files")
    assert s.table("query_log").count() == 7
