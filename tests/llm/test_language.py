import zlib

import numpy as np

from kinfold.llm import language


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predictions(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(odd, no_docs):
    df, rows = odd
    got = language.predictions(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (3, 4, 5, 11):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = language.accepted(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, t, *_ in rows if t and any(c.isalpha() for c in t))
    assert language.predictions(no_docs).count() == 0
    assert language.predictions(df.where("lang is null")).where("lang_pred <> 'und'").count() == 0


def test_product_equals_that_of_the_whole_vector():
    import pyarrow as pa

    text, key, count = language._trigrams(pa.array(["Abc abd, x", "été"]))
    v = language._vectors(key).astype(int)
    assert set(v.ravel()) == {1, -1} and v.shape[1] == language.DIM
    proto = np.random.default_rng(1).standard_normal(language.DIM)
    for t in (0, 1):
        own = text == t
        assert np.isclose((count[own] @ v[own]) @ proto, (count[own] * (v[own] @ proto)).sum())
    # " ab" twice, "abc", "bc ", "abd", "bd ", " x "
    assert count[text == 0].sum() == 7 and (text == 1).sum() == 3
