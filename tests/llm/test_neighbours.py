import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import neighbours


def brute(rows, every, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors.setdefault((i, tuple(v)), np.array(v, float))
    out = {}
    for (i, key), q in vectors.items():
        if i % every == 0:
            near = [(-(q @ c) / (np.linalg.norm(q) * np.linalg.norm(c)), j) for (j, _), c in vectors.items() if j != i and len(c) == len(q)]
            out.setdefault(i, []).extend(near)
    return {i: sorted(near)[:k] for i, near in out.items()}


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 50, 5)
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, near in got.items():
        assert [n for n, *_ in near] == [1, 2, 3, 4, 5]
        exact = {j: -s for s, j in want[q]}
        hits += sum(v in exact for _, v, _ in near)
        assert all(s == pytest.approx(exact[v]) for _, v, s in near if v in exact)
    assert hits / (5 * len(want)) >= 0.9


def test_small_blocks_equal_one_block(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one = sorted(map(tuple, neighbours.search(df).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4 * 8 * 64)
    many = sorted(map(tuple, neighbours.search(df).collect()))
    assert [x[:3] for x in one] == [x[:3] for x in many]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]),
        (9, [1.0, 1.0, 1.0]), (10, [-1.0, 0.0]), (11, [0.0, 1e300]), (50, [0.0, 0.0, 5.0]), (100, [1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "2 as score", "'x' as rank")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 11, 0.0), (0, 4, 10, -1.0), (50, 1, 9, round(3**-0.5, 9))]
    assert neighbours.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1, 48, 64, 130])
def test_bounds_hold(dim):
    rng = np.random.default_rng(2)
    own, queries = neighbours.unit(rng.standard_normal((400, dim))), neighbours.unit(rng.standard_normal((20, dim)))
    middle = neighbours.fit(own, 4)
    codes = neighbours.Codes(own, middle)
    names = ["bits", *neighbours.Codes.COLUMNS]
    again = neighbours.Codes.read(pa.table(dict(zip(names, codes.arrays(), strict=True))), dim)
    estimate, error = again.estimate(queries, middle)
    true = queries @ own.T
    assert (abs(estimate - true) <= error).mean() > 0.99
    # the products of signs and of rotated queries are those that bits and planes stand for
    signs = np.unpackbits(codes.words.view(np.uint8), axis=1)[:, :dim] * 2.0 - 1
    turned = queries @ neighbours.rotation(dim).T
    far = (turned @ signs.T) / np.sqrt(dim) - codes.middle
    plain = (queries @ middle.T)[:, codes.cell] + np.where(codes.fit > 1e-9, codes.length * far / np.where(codes.fit > 1e-9, codes.fit, 1), 0)
    assert abs(plain - estimate).max() < 0.2 and abs(plain - true).mean() < 0.2


def test_recall_on_more_vectors():
    """Of 20,000 vectors in 64 dimensions the whole of a block's best is found for nearly all queries."""
    rng = np.random.default_rng(3)
    own = neighbours.unit(rng.standard_normal((20_000, 64)))
    ids, middle = np.arange(20_000), neighbours.fit(own[:8192])
    found = neighbours.nearest(neighbours.Codes(own, middle), own, ids, own[:100], ids[:100], middle, 5)
    hits = 0
    for q, (_, near, _) in enumerate(found):
        score = own @ own[q]
        score[q] = -2
        hits += len(set(near) & set(np.argsort(-score)[:5]))
    assert hits >= 495
