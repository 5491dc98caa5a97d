"""Strong components across tasks against the search of one task."""

import random

import pytest

from codelode.operators import graph, strong


def plain(pairs):
    comp = graph.strong_components_of(pairs)
    size = {c: sum(x == c for x in comp.values()) for c in comp.values()}
    return sorted((n, c, size[c], size[c] > 1 or (n, n) in pairs) for n, c in comp.items())


def made(kind, rng):
    if kind == "random":
        return [(rng.randrange(80), rng.randrange(80)) for _ in range(110)]
    if kind == "giant":
        return [(rng.randrange(60), rng.randrange(60)) for _ in range(200)] + [(100 + k, 101 + k) for k in range(10)]
    if kind == "rings":  # bare cycles, a ring with a tail, a chain from a ring to a ring and one that comes back
        ring = lambda a, n: [(a + k, a + (k + 1) % n) for k in range(n)]
        return ring(0, 7) + ring(20, 2) + ring(30, 5) + [(33, 40), (40, 41), (41, 42)] + ring(50, 4) + [(32, 60), (60, 61), (61, 50)] + [(90, 95), (95, 96), (96, 90), (90, 97), (97, 90), (99, 99), (98, 99)]
    return [(k, k + 1) for k in range(25)] + [(k + 1, k) for k in range(8, 12)] + [(22, 18)]


@pytest.mark.parametrize("finish", [0, 30, None])
@pytest.mark.parametrize("kind", ["random", "giant", "rings", "ladder"])
def test_equals_one_task(spark, kind, finish):
    pairs = made(kind, random.Random(7))
    got = strong.strong_components(spark.createDataFrame(pairs, "src long, dst long").repartition(3), finish)
    assert sorted(map(tuple, got.collect())) == plain(pairs)


def test_long_chain_and_ring(spark):
    """5000 nodes in a row are 5000 components, and in a ring one, in a few rounds of doubling."""
    chain = [(k, k + 1) for k in range(4999)]
    got = strong.strong_components(spark.createDataFrame(chain, "src long, dst long"), 0)
    assert got.select("component").distinct().count() == 5000 and got.where("cyclic").count() == 0
    got = strong.strong_components(spark.createDataFrame([*chain, (4999, 0), (2500, 9000), (9001, 17)], "src long, dst long"), 0)
    assert got.where("component = 0 AND size = 5000 AND cyclic").count() == 5000 and got.count() == 5002


def test_empty(spark):
    assert strong.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert sorted(map(tuple, strong.strong_components(spark.createDataFrame([(1, 1), (2, 2)], "src long, dst long")).collect())) == [(1, 1, 1, True), (2, 2, 1, True)]
