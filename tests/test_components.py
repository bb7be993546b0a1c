import random

import pytest

from kinfold.operators import components


def brute(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("last", [0, 1 << 19])
@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components_equal_union_find(spark, monkeypatch, last, kind):
    monkeypatch.setattr(components, "LAST_STEP", last)
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "chain": [(i, i + 1) for i in range(30)],
        "star": [(50, i) for i in range(20)], "loops": [(1, 1), (2, 3), (3, 2), (-5, 9)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
    got = {r["id"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
