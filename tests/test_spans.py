"""Stabbing joins over random spans, crossing ones too, against a scan of all spans."""

import random

import pytest

from codelode.operators import spans


def made(seed, n=300, crossing=True):
    rng, rows = random.Random(seed), []
    for k in range(n):
        f, s = rng.randrange(4), rng.randrange(200)
        e = s + rng.choice([0, 1, 2, 5, 17, 60, 300, 4000])
        rows.append((f, k, s, e))
    if not crossing:
        rows = [r for r in rows if not any(o[0] == r[0] and (o[2] < r[2] < o[3] < r[3] or r[2] < o[2] < r[3] < o[3]) for o in rows)]
    return rows


@pytest.mark.parametrize("block", [7, 64, spans.BLOCK])
@pytest.mark.parametrize("crossing", [True, False])
def test_innermost(spark, block, crossing):
    rows = made(1, 200, crossing)
    points = [(f, at, f"p{at}") for f in range(5) for at in range(0, 4300, 13)] + [(0, 5, "again"), (None, 3, "x")]
    want = []
    for f, at, name in points:
        held = [(s, -e, k) for g, k, s, e in rows if g == f and s <= at < e]
        want.append((f, at, name, max(held)[2] if held else None))
    df = spark.createDataFrame(rows, "file_id long, id long, start_byte long, end_byte long")
    got = spans.innermost(spark.createDataFrame(points, "file_id long, at long, id string"), df, block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["file_id", "at", "id", "span_id"]


@pytest.mark.parametrize("crossing", [True, False])
def test_containing(spark, crossing):
    rows = made(2, 150, crossing)
    want = {}
    for f, k, s, e in rows:
        up = [(b - a, i) for g, i, a, b in rows if g == f and a <= s and e <= b and b - a > e - s]
        want[k] = min(up)[1] if up else None
    got = spans.containing(spark.createDataFrame(rows, "file_id long, id long, start_byte long, end_byte long"))
    assert {r.id: r.parent_id for r in got.collect()} == want
    assert spans.containing(got.selectExpr("id AS file_id", "id", "id AS start_byte", "id AS end_byte").where("false")).count() == 0


def test_plan_has_no_range_join(spark, capsys):
    rows = spark.createDataFrame(made(3), "file_id long, id long, start_byte long, end_byte long")
    spans.innermost(rows.selectExpr("file_id", "start_byte AS at"), rows).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_references(spark):
    """A method that names a function, itself, an unknown word and, outside all symbols, nothing."""
    text = ["class Engine:", "    def start(self):", "        return start or spin(Ünit, 3, start2)", "def spin(x): Engine", "spin(1)"]
    at = [0]
    for line in text:
        at.append(at[-1] + len(line.encode()) + 1)
    lines = spark.createDataFrame([(1, k, line, at[k]) for k, line in enumerate(text)], "file_id long, pos int, line string, start_byte long")
    tokens = spans.identifiers(lines)
    want = [(1, "return", at[2] + 8), (1, "nit", at[2] + 8 + len("return start or spin(Ü".encode()))]
    assert set(want) <= {tuple(r) for r in tokens.collect()} and "3" not in {r.name for r in tokens.collect()}
    symbols = [(1, 10, "Engine", "class", at[0], at[3] - 1), (1, 11, "start", "method", at[1] + 4, at[3] - 1), (1, 12, "spin", "function", at[3], at[4] - 1), (1, 13, "spin", "method", at[3], at[3] + 4), (1, 14, "self", "field", 0, 1)]
    got = spans.references(tokens, spark.createDataFrame(symbols, "file_id long, id long, name string, kind string, start_byte long, end_byte long"))
    # "def spin": the shorter span of the name itself is the innermost one there
    assert sorted(map(tuple, got.collect())) == [(1, 11, 12, "spin", "references"), (1, 12, 10, "Engine", "references")]
