"""Recursive tables against DuckDB, with cycles, several parts, other tables around them, and the bound on rounds."""

import duckdb
import pytest

from codelode.sources import recursive, store

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 6), (7, None), (None, 8)]
STATEMENTS = [
    "WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM ed UNION SELECT r.a, ed.dst FROM r JOIN ed ON r.b = ed.src) SELECT a, b FROM r",
    "WITH RECURSIVE n AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM n WHERE k < 12) SELECT k, k * k AS q FROM n WHERE k % 2 = 0",
    "WITH RECURSIVE few AS (SELECT * FROM ed WHERE src < 4), r(id) AS (SELECT 3 UNION SELECT 5 UNION SELECT few.dst FROM few, r WHERE few.src = r.id), s AS (SELECT id FROM r) SELECT count(*) AS c, sum(id) AS t FROM s",
    "WITH RECURSIVE a(x) AS (SELECT 1 UNION SELECT x + 1 FROM a WHERE x < 4), b(y) AS (SELECT x FROM a UNION SELECT y * 2 FROM b WHERE y < 9) SELECT y FROM b",
    "WITH RECURSIVE z(x) AS (SELECT src FROM ed WHERE src > 99 UNION SELECT x FROM z) SELECT x FROM z",
    "SELECT 'WITH RECURSIVE' AS t",
]


@pytest.fixture(scope="module")
def ed(spark):
    spark.createDataFrame(EDGES, "src long, dst long").createOrReplaceTempView("ed")


@pytest.mark.parametrize("k", range(len(STATEMENTS)))
def test_equals_duckdb(spark, ed, k):
    con = duckdb.connect()
    con.execute("CREATE TABLE ed(src BIGINT, dst BIGINT)")
    con.executemany("INSERT INTO ed VALUES (?, ?)", EDGES)
    got = recursive.run(STATEMENTS[k], spark.sql)
    rel = con.execute(STATEMENTS[k])
    assert got.columns == [c[0] for c in rel.description]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_several_steps(spark, ed):
    """Two parts that name the table, which DuckDB does not take."""
    got = recursive.run("WITH RECURSIVE few AS (SELECT * FROM ed WHERE src < 4), r(id) AS (SELECT 3 UNION SELECT 5 UNION SELECT few.dst FROM few, r WHERE few.src = r.id UNION SELECT 10 + r.id FROM r WHERE r.id < 4) SELECT id FROM r", spark.sql)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5, 11, 12, 13]


def test_bound_and_refusals(spark, ed):
    with pytest.raises(recursive.TooManyRounds):
        recursive.run("WITH RECURSIVE n(k) AS (SELECT 1 UNION SELECT k + 1 FROM n) SELECT * FROM n", spark.sql, rounds=5)
    assert recursive.run("WITH RECURSIVE n(k) AS (SELECT 1 UNION SELECT k + 1 FROM n WHERE k < 6) SELECT * FROM n", spark.sql, rounds=6).count() == 6
    for bad in ("WITH RECURSIVE n(k) AS (SELECT k FROM n) SELECT * FROM n", "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n LIMIT 3) SELECT * FROM n", "WITH RECURSIVE n(k AS (SELECT 1) SELECT 1"):
        with pytest.raises(ValueError):
            recursive.run(bad, spark.sql)


def test_from_a_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.write("symbols", spark.createDataFrame([(k, 1, f"n{k}", k - 1 if k else None) for k in range(5)], "id long, file_id long, name string, parent_id long").selectExpr("id", "file_id", "name", "'class' AS kind", "'x' AS lang", "1L AS start_line", "1L AS end_line", "0L AS start_byte", "1L AS end_byte", "parent_id", "cast(null AS map<string,string>) AS attrs", "cast(null AS array<string>) AS provenance"))
    up = "WITH RECURSIVE up(id, name) AS (SELECT parent_id, name FROM symbols WHERE name LIKE 'N4' UNION SELECT s.parent_id, s.name FROM symbols s JOIN up ON s.id = up.id) SELECT group_concat(name, '<') FROM (SELECT name FROM up ORDER BY name)"
    assert sorted(s.query(up).first()[0].split("<")) == [f"n{k}" for k in range(5)]
    with pytest.raises(ValueError):
        s.query("WITH RECURSIVE n(k) AS (SELECT 1 UNION SELECT k + 1 FROM n WHERE k < 3) INSERT INTO files SELECT * FROM n")
