import random

import pytest

WORDS = "the of and to in river stone light under morning seldom quiet garden winter hollow amber finch ledger marble orchard".split()


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice("abcdefgh") * (i % 3 == 0))
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short and very long texts, ties, repeated rows, and columns named like those that operators add."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    plain = prose(rng, 120)
    rows = [
        (1, plain, "en", "a"), (2, plain.upper(), "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "b"), (6, "word", "en", "b"), (7, "word", "en", None),
        (8, long, "en", "b"), (9, long + " more", "en", "b"), (10, plain, None, "c"), (10, plain, None, "c"), (None, prose(rng, 80), "en", "c"), (None, None, None, None), (11, "123 456 !!!", "en", "c"), (12, prose(rng, 90), "en", "a"),
    ]
    extra = "1 as size, 'x' as key, 2.0 as score, 'y' as lang_pred, 'z' as shard, 5 as block, 0 as h, 7 as item_id, true as contaminated, 'r' as row, 'n' as n, 1 as bits, 'm' as marks, 9 as text_key, 4 as round, 'q' as `order`, 'u' as doc, 8 as at, 'd' as `a.b`, 'e' as `c d``e`"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *extra.split(", "))
    return df, rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
