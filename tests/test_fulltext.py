"""The stored full-text index against a scan of all files, through changes and merges, and from SQL."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.operators import search
from codelode.sources import fulltext, store

QUERIES = ["alpha", "alpha beta", "alpha OR gamma", "alpha NOT gamma", '"lpha be"', "(delta OR gamma) NOT (alpha beta)", "ab", "ALPHA", "mma gam", "alpha OR ab", "pt/f1", "alpha NOT ab"]


def made(seed, ids):
    rng = random.Random(seed)
    return {k: (f"pt/f{k}", " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "aaaa", "été"], k=rng.randrange(9)))) for k in ids}


def frame(spark, files):
    return spark.createDataFrame([(k, *v) for k, v in files.items()], "id long, path string, content string")


def holds(tree, text):
    if tree[0] == "term":
        return len(tree[1]) > 2 and any(tree[1].lower() in t.lower() for t in text)
    if tree[0] == "not":
        return holds(tree[1], text) and not holds(tree[2], text)
    return (all if tree[0] == "and" else any)(holds(p, text) for p in tree[1])


def check(spark, index, files):
    df = frame(spark, files)
    for q in QUERIES:
        tree = search.parse(q)
        want = sorted(k for k, v in files.items() if holds(tree, v))
        assert sorted(r.id for r in index.match(df, q).select("id").collect()) == want, q


def test_changes_and_merges(spark, tmp_path):
    files, at = made(1, range(40)), str(tmp_path / "index")
    index = fulltext.FullText(spark, at, buckets=5)
    assert index.match(frame(spark, files), "alpha").count() == 0
    index.put(frame(spark, files))
    check(spark, index, files)
    for step in range(6):
        changed = made(10 + step, range(5 * step, 5 * step + 9))
        files |= changed
        index.put(frame(spark, changed))
        if step % 2:
            gone = range(3 * step, 3 * step + 4)
            index.remove(spark.createDataFrame([(k,) for k in gone], "id long"))
            files = {k: v for k, v in files.items() if k not in gone}
        if step in (1, 3, 5):
            again = fulltext.FullText(spark, at)
            assert (again.version, again.generations, again.buckets) == (index.version, index.generations, 5)
            check(spark, again, files)
            # ids that are no longer in the index are not found even where the files are
            everything = frame(spark, {**made(1, range(100, 103)), **files, 999: ("pt/f999", "alpha beta gamma")})
            assert 999 not in {r.id for r in again.match(everything, "alpha").collect()}
    assert len(index.generations) <= fulltext.GENERATIONS
    assert index.statistics()[0] == len(files)
    index.merge()
    assert len(index.generations) == 1
    check(spark, index, files)


def test_broken_change_leaves_the_old_state(spark, tmp_path, monkeypatch):
    files, at = made(2, range(20)), str(tmp_path / "index")
    index = fulltext.FullText(spark, at, buckets=3)
    index.put(frame(spark, files))
    monkeypatch.setattr(index, "_commit", lambda names: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.put(frame(spark, {1: ("new", "alpha alpha")}))
    check(spark, fulltext.FullText(spark, at), files)
    late, other = fulltext.FullText(spark, at), fulltext.FullText(spark, at)
    other.put(frame(spark, {50: ("new", "alpha")}))
    with pytest.raises(Exception, match="(?i)exist"):
        late.put(frame(spark, {51: ("late", "alpha")}))
    check(spark, fulltext.FullText(spark, at), files | {50: ("new", "alpha")})


def test_reads_only_the_buckets_of_its_grams(spark, tmp_path, capsys):
    index = fulltext.FullText(spark, str(tmp_path / "index"))
    index.put(frame(spark, made(3, range(30))))
    index.postings(["alp", "lph"]).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(gram" in plan
    read = index.postings(["alp"])
    assert len(read.inputFiles()) >= 1 and read.where("gram <> 'alp'").count() == 0


def test_rank(spark, tmp_path):
    files = made(4, range(60)) | {100: ("pt/aaaaa", "aaaaaa")}
    index = fulltext.FullText(spark, str(tmp_path / "index"), buckets=4)
    index.put(frame(spark, files))
    size = {k: sum(max(0, len(x) - 2) for x in v) for k, v in files.items()}
    count = lambda t, v: sum(x[i : i + len(t)].lower() == t for x in v for i in range(len(x)))
    mean, n = sum(size.values()) / len(size), len(files)
    for q in ("alpha", "alpha gamma", "alpha OR delta", "aaaa", "beta NOT alpha"):
        tree = search.parse(q)
        want = {}
        for k, v in files.items():
            if holds(tree, v):
                score = 0.0
                for t in search.terms_of(tree):
                    df = sum(count(t, x) > 0 for x in files.values())
                    f = count(t, v)
                    score += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[k] / mean))
                want[k] = -score
        got = {r.id: r["rank"] for r in index.ranked(frame(spark, files), q).collect()}
        assert got == pytest.approx(want), q
    assert index.ranked(frame(spark, files), " ").count() == 0


def test_rank_from_sql(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    files = made(5, range(30))
    s.write("files", frame(spark, files).select("id", "path", F.lit(".txt").alias("ext"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), "content"))
    ask = "SELECT rowid, rank FROM files_fts WHERE files_fts MATCH 'alpha NOT gamma' ORDER BY rank, rowid LIMIT 5"
    plain = [tuple(r) for r in s.query(ask).collect()]
    joined = "SELECT f.id FROM files_fts t JOIN files f ON f.id = t.rowid WHERE t MATCH 'alpha NOT gamma' AND f.size > 0 ORDER BY t.rank, f.id LIMIT 5"
    for _ in range(2):
        index = s.index_text()
        assert [tuple(r) for r in s.query(ask).collect()] == [(k, pytest.approx(v)) for k, v in plain] and plain
        assert [r.id for r in s.query(joined).collect()] == [k for k, _ in plain]
    assert index.statistics()[0] == 30
    two = "SELECT count(*) FROM files_fts WHERE files_fts MATCH 'alpha' AND rowid NOT IN (SELECT rowid FROM files_fts WHERE files_fts MATCH 'beta')"
    assert s.query(two).first()[0] == sum("alpha" in c and "beta" not in c for _, c in files.values())


def test_stores_lists_and_no_row_for_each_posting(spark, tmp_path):
    index = fulltext.FullText(spark, str(tmp_path / "index"), buckets=3)
    index.put(spark.range(400).selectExpr("id", "'pt' path", "'Alpha \U0001f600beta' content").coalesce(1))
    stored = spark.read.parquet(index._at(index.generations[0], "postings"))
    low = "alpha \U0001f600beta"
    assert sorted(r.gram for r in stored.select("gram").collect()) == sorted(low[k : k + 3] for k in range(len(low) - 2))
    assert stored.selectExpr("min(size(file_ids)) lo", "max(size(file_ids)) hi").first() == (400, 400)
    index.merge()
    assert spark.read.parquet(index._at(index.generations[0], "postings")).count() == len(low) - 2
    assert index.postings(["pha"]).select("file_id").distinct().count() == 400


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        index = fulltext.FullText(spark, str(tmp_path / "index"), buckets=1)
        index.put(spark.range(0, 2000, 1, 8).selectExpr("id", "concat('pt/', hex(id * 7919))  path", "concat('Alpha beta ', sha1(string(id))) content"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(index._at(index.generations[0], "postings"))
    assert len(stored.inputFiles()) > 3
    assert index.postings(["pha"]).select("file_id").distinct().count() == index.postings(["pha"]).count() == 2000


def test_lists_of_odd_texts(spark, monkeypatch):
    rows = [(1, None, None), (2, "a", ""), (3, "ABCd", "\U0001f600\U0001f600\U0001f600x\n\nÉÉÉ"), (4, "abc", "ABCABC"), (-5, None, "éééé"), (2**40, "xyzé", None), (None, "abc", "abc")]
    df = spark.createDataFrame(rows, "id long, path string, content string").coalesce(1)
    got = [(r.gram, k) for r in search.posting_lists(df).collect() for k in r.file_ids]
    want = {(t.lower()[j : j + 3], k) for k, *two in rows if k is not None for t in two if t for j in range(len(t) - 2)}
    assert len(got) == len(want) and set(got) == want
    # texts of more than a block, and more characters than three of them and a file fit into one number
    monkeypatch.setattr(search, "BLOCK", 1000)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abc", k=n)) for n in (0, 2, 3, 999, 1000, 1001, 1002, 5000)]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for block, some in ((1000, texts), (1 << 22, [*texts, every])):
        monkeypatch.setattr(search, "BLOCK", block)
        got = [(g, k) for b in search._lists(np.arange(len(some)), some, ["zz"] * len(some)) for g, ks in zip(b["gram"].to_pylist(), b["file_ids"].to_pylist()) for k in ks]
        want = {(t[j : j + 3], k) for k, t in enumerate(some) for j in range(len(t) - 2)}
        assert len(got) == len(want) and set(got) == want


def test_rank_sends_no_texts(spark, tmp_path):
    files = made(7, range(40))
    index = fulltext.FullText(spark, str(tmp_path / "index"), buckets=3)
    index.put(frame(spark, files))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.ranked(frame(spark, files), "alpha gamma").select("id", "path", "rank")
        plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
        assert len(sent) > 3 and not [x for x in sent if "content#" in x]
        assert {r.id for r in found.collect()} == {k for k, v in files.items() if holds(search.parse("alpha gamma"), v)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_of_the_older_layout_is_not_read(spark, tmp_path):
    s, files = store.Store(spark, str(tmp_path / "store")), made(8, range(9))
    s.write("files", frame(spark, files).select("id", "path", F.lit(".txt").alias("ext"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), "content"))
    spark.createDataFrame([(0, "old", 64)], "number int, generation string, buckets int").coalesce(1).write.parquet(f"{s.path}/fulltext/versions/1")
    ask, want = "SELECT rowid FROM files_fts WHERE files_fts MATCH 'alpha'", sorted(k for k, v in files.items() if "alpha" in v[1])
    assert sorted(r.rowid for r in s.query(ask).collect()) == want
    assert s.index_text().version == 2
    assert sorted(r.rowid for r in s.query(ask).collect()) == want
