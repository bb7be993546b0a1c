from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing


def targets(sizes):
    """The contract's targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
        left -= sum(2 * sizes[s] for s in over)
    return out


def check(rows, slack):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r, source in rows:
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= slack * sizes[s], s


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = mixing.report(docs).collect()
    assert len(rows) == len(source)
    check([(r, source[r["doc_id"]]) for r in rows], mixing.NEAR)
    again = mixing.report(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(odd, no_docs):
    df, rows = odd
    got = mixing.report(df).collect()
    assert len(got) == len(rows)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"], r["text"]] += 1
    assert times and max(times.values()) <= 4  # a row that stands twice may be taken twice each time
    assert mixing.report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(1, 400), (2, 100), (3, 7), (4, 0)], "place long, n long")
    got = np.zeros((4, 8), int)
    for r in mixing.split(quotas, 3).collect():
        got[r["place"] - 1, r["shard"]] = r["quota"]
    assert got.sum(axis=1).tolist() == [400, 100, 7, 0]
    assert set(got.sum(axis=0)) <= {63, 64}
    # each shard's share of the large source stays within a few standard deviations
    assert (abs(got[0] - 50) < 5 * np.sqrt(64 * 0.79 * 0.21)).all()


def test_hypergeometric_inverts_the_distribution(spark):
    from math import comb

    total, marked, take = 30, 12, 10
    sql = mixing._hypergeometric(str(total), str(marked), str(take), "u")
    n = 2000
    got = spark.range(n).selectExpr(f"(id + 0.5D) / {n} as u").selectExpr(f"{sql} as k").groupBy("k").count().collect()
    for r in got:
        want = comb(marked, r["k"]) * comb(total - marked, take - r["k"]) / comb(total, take)
        assert abs(r["count"] / n - want) < 2 / n
    assert spark.sql(f"select {mixing._hypergeometric('5', '5', '3', '0.4D')} as k").first()["k"] == 3
    assert spark.sql(f"select {mixing._hypergeometric('5', '0', '3', '0.4D')} as k").first()["k"] == 0


def test_gap_of_one_very_long_document_is_closed(spark):
    rng = np.random.default_rng(0)
    units = []
    for place in range(12):
        h = np.sort(rng.choice(1 << 40, 1001, replace=False)).tolist()
        long = int(rng.integers(1001))
        units += [(place, i // 16, x, 200_000 if i == long else 200) for i, x in enumerate(h)]
    units = spark.createDataFrame(units, "place long, block long, h long, size long")
    goals = spark.createDataFrame([(p, 400_000, 1001, 80_000.0) for p in range(12)], "place long, source_size long, n long, target double")
    rows = mixing._taken(units, mixing.draws_of(units, goals)).collect()
    assert len({(r["place"], r["h"]) for r in rows}) == len(rows)
    got = defaultdict(int)
    for r in rows:
        got[r["place"]] += r["size"]
    assert all(abs(got[p] - 80_000) <= 0.002 * 400_000 for p in range(12)), got


def test_exchange_takes_the_nearest_pair(spark):
    rng = np.random.default_rng(1)
    units, gaps, want = [], [], {}
    for place in range(20):
        size = rng.integers(50, 90, 12).tolist()
        units += [(place, 0, h, x, h < 6) for h, x in enumerate(size)]
        gap = float(rng.integers(-40, 40)) + 0.5
        gaps.append((place, gap))
        best = min((abs(gap - y + x), x, y, hx, hy) for hy, y in enumerate(size) if hy >= 6 for hx, x in [(None, 0), *list(enumerate(size))[:6]])
        want[place] = {h for h in best[3:] if h is not None} if best[0] < abs(gap) else set()
    df = spark.createDataFrame(units, "place long, block long, h long, size long, taken boolean")
    got = defaultdict(set)
    for r in mixing._exchange(df, spark.createDataFrame(gaps, "place long, gap double")).collect():
        got[r["place"]].add(r["h"])
    assert {p: got[p] for p in want} == want


def test_shards_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in mixing.report(docs, 20_000).collect()]
    assert len({r[5] for r in got}) > 8
    assert sorted(got) == sorted(con.execute(mixing.oracle(20_000)).fetchall())
    assert mixing.mix(docs, 20_000).count() == sum(len(r[5].split(",")) for r in got if r[5])


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(int(p), int(k)) for p, k in zip(rng.integers(0, 3, 500), rng.choice(1 << 48, 500, replace=False))]
    df = spark.createDataFrame(rows, "place long, k long")
    for r in mixing.running(df, F.col("k"), F.lit(1), "upto").collect():
        assert r["upto"] == sum(p == r["place"] and k <= r["k"] for p, k in rows)
