import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    out = []
    for r in rows:
        out.append(tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if isinstance(v, (list, tuple)) else v for v in r))
    return sorted(out, key=repr)


def same(df, con, sql):
    """Rows of a DataFrame and of SQL, by column name, in any order."""
    names = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*names).collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    return got, canonical(tuple(row[i] for i in order) for row in rel.fetchall())
