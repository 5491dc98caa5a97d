"""Layers against plain peeling: branches, chains, cycles and what lies behind them; a long chain in few jobs."""

import random

import pytest

from codelode.operators import graph


def plain(pairs):
    pairs = {(a, b) for a, b in pairs if a != b}
    left, out, layer = {n for p in pairs for n in p}, {}, 0
    while True:
        now = left - {b for a, b in pairs}
        if not now:
            return out, left
        out |= dict.fromkeys(now, layer)
        left, layer, pairs = left - now, layer + 1, {(a, b) for a, b in pairs if a not in now}


def made(kind):
    rng = random.Random(3)
    if kind == "dag":
        return [tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)]
    if kind == "chains":  # two ways of different length between two nodes, a way round a way, a chain into a cycle
        return [(0, 1), (1, 2), (2, 3), (3, 9), (0, 5), (5, 9), (9, 10), (10, 11), (11, 12), (20, 21), (21, 22), (22, 20), (12, 30), (30, 31), (31, 32), (32, 30), (32, 40), (40, 41), (50, 50), (60, 61), (0, 9)]
    return [(rng.randrange(50), rng.randrange(50)) for _ in range(55)]


@pytest.mark.parametrize("kind", ["dag", "chains", "random"])
def test_layers(spark, kind):
    pairs = made(kind)
    got, left = graph.layers(spark.createDataFrame(pairs, "src long, dst long"))
    want, rest = plain(pairs)
    assert {r.id: r.layer for r in got.collect()} == want and {r.id for r in left.collect()} == rest


def test_long_chain_in_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layers", "layers")
    got, left = graph.layers(spark.range(600).selectExpr("id AS src", "id + 1 AS dst"))
    assert got.where("id <> layer").count() == 0 and got.count() == 601 and left.count() == 0
    jobs = len(tracker.getJobIdsForGroup("layers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 180  # adaptive execution runs a job a shuffle; peeling would take over 2400


def test_nothing(spark):
    got, left = graph.layers(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert got.count() == left.count() == 0
