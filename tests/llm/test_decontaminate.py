import random

import numpy as np

from kinfold.llm import decontaminate
from kinfold.llm._words import U

from .conftest import prose


def greedy(doc, item, least):
    """Greedy string tiling by trying all pairs of places in every round."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < least:
            return sum(x for *_, x in out)
        for k in range(n):
            free_d[i + k] = free_i[j + k] = False
        out.append((i, j, n))


def test_tiles_equal_the_plain_method():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(3, 25)).astype(U)
        doc = rng.integers(0, 6, rng.integers(3, 60)).astype(U)
        at = rng.integers(0, len(doc))
        doc = np.concatenate([doc[:at], item[len(item) // 2 :], doc[at:], item[: len(item) // 2]])
        got = decontaminate.tiles(doc, item, 3)
        assert sum(n for *_, n in got) == greedy(doc.tolist(), item.tolist(), 3)
        for i, j, n in got:
            assert (doc[i : i + n] == item[j : j + n]).all()


def test_reordered_and_partial_passages(spark, odd, no_docs, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, 40) for _ in range(6)]
    parts = items[0].split()
    shuffled = " ".join(parts[26:] + parts[13:26] + parts[:13])
    texts = [
        prose(rng, 80), prose(rng, 30) + " " + items[0].upper() + " " + prose(rng, 30), "x " + shuffled + " y", " ".join(parts[:12]) + " " + prose(rng, 60),
        prose(rng, 20_000) + " " + items[1], items[2], None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "the"), (5, items[5])], "item_id long, text string")
    want = {0: False, 1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}
    for rows in (decontaminate.INDEX_ROWS, 50):
        monkeypatch.setattr(decontaminate, "INDEX_ROWS", rows)
        got = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
        assert {k: r["contaminated"] for k, r in got.items()} == want
        assert [got[k]["item_id"] for k in (1, 2, 4, 5)] == [0, 0, 1, 2] and got[5]["coverage"] == 1.0
    df, rows = odd
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert decontaminate.report(no_docs, bench).count() == 0
    assert decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_planted_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    got = {r["doc_id"] for r in decontaminate.report(docs, bench).where("contaminated").collect()}
    assert want and got == want
