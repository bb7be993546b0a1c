import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import quality


def brute(texts, order=quality.ORDER):
    """A function that gives the log2 probability of a text, by the recursion written out over dictionaries."""
    counts = {}
    pad = "\0" * (order - 1)
    for t in texts:
        t = pad + " ".join(t.split())
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            counts[g] = counts.get(g, 0) + 1
    levels, params = {order: counts}, {}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    for k, c in levels.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(float(i), max(0.1, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, free = {}, {}
        for g, v in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            free[g[:-1]] = free.get(g[:-1], 0) + d[min(v, 3) - 1]
        params[k] = d, total, free

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        d, total, free = params[k]
        if g[:-1] not in total:
            return p(g[1:])
        v = levels[k].get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[g[:-1]] + free[g[:-1]] / total[g[:-1]] * p(g[1:])

    def bits(t):
        t = pad + " ".join(t.split())
        return -sum(np.log2(p(t[i - order + 1 : i + 1])) for i in range(order - 1, len(t)))

    return bits, p


TEXTS = ["the river and the stone. the river and the light", "quiet garden under the morning light", "ab  ab\tab\nab", "naïve 你好 😀 café"]
ASKED = [*TEXTS, "the stone under the garden", "zzz qqq", "x", "你你 the"]


@pytest.mark.parametrize("rows", [quality.MODEL_ROWS, 0])
def test_bits_equal_the_recursion(spark, rows):
    bits, p = brute(TEXTS)
    orders, unseen = quality.train(spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string"))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*ASKED, None, ""])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.perplexities(asked, orders, unseen, rows).collect()}
    for i, t in enumerate(ASKED):
        assert got[i]["n"] == len(" ".join(t.split())) and got[i]["bits"] == pytest.approx(bits(t), rel=1e-4)
    assert [(got[i]["n"], got[i]["bits"]) for i in (len(ASKED), len(ASKED) + 1)] == [(0, 0), (0, 0)]
    letters = {c for t in TEXTS for c in " ".join(t.split())}
    assert sum(p("he r" + c) for c in letters) + p("he r\u2603") == pytest.approx(1)


def test_counts_are_those_of_the_text(spark):
    got = {r["gram"]: r["c"] for r in quality.counts(spark.createDataFrame([("ab  ab",), (None,), ("",)], "text string")).collect()}
    assert got == {"\0\0\0\0a": 1, "\0\0\0ab": 1, "\0\0ab ": 1, "\0ab a": 1, "ab ab": 1}


def test_junk_goes_and_clean_text_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    good = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < sum(good) / len(good)


def test_odd_rows(spark, odd, no_docs):
    df, rows = odd
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, None), (9, 1, 1), (None, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    assert all(r["keep"] and r["perplexity"] == 1 for r in got if r["n_chars"] == 0)
    none = quality.classify(df, labels.limit(0)).collect()
    assert all(r["keep"] and r["threshold"] is None for r in none)
    assert quality.classify(no_docs, labels).count() == 0
