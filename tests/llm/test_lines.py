import random
from collections import Counter

from kinfold.llm import lines


def brute(rows):
    """``(doc_id, n_lines, deleted, runs)`` of each row by the longest earlier match of every place."""
    order = lambda d: (d is None, 0 if d is None else d)
    seqs = {t: t.split("\n") if t else [] for _, t, *_ in rows}
    least = {t: min((d for d, u, *_ in rows if u == t), key=order) for t in seqs}
    match = {}
    for t, s in seqs.items():
        for i in range(len(s)):
            best = (0, None)
            for u, z in seqs.items():
                for j in range(len(z)):
                    if (order(least[u]), j) < (order(least[t]), i):
                        n = 0
                        while i + n < len(s) and j + n < len(z) and s[i + n] == z[j + n]:
                            n += 1
                        if n > best[0] or n and n == best[0] and (order(least[u]), j) < (order(best[1][0]), best[1][1]):
                            best = (n, (least[u], j))
            match[t, i] = best
    out = Counter()
    for d, t, *_ in rows:
        s = seqs[t]
        found = [(i, i + match[t, i][0], *match[t, i][1]) for i in range(len(s)) if match[t, i][0] and not (i and match[t, i - 1][0] == match[t, i][0] + 1)]
        found = [r for r in found if len(" ".join(s[r[0] : r[1]]).split()) >= lines.WORDS]
        if s and order(d) > order(least[t]):
            found = [(0, len(s), least[t], 0)]
        out[d, len(s), tuple(sorted({p for a, b, *_ in found for p in range(a, b)})), tuple(sorted(found, key=lambda r: r[:2]))] += 1
    return out


def result(df):
    return Counter((r["doc_id"], r["n_lines"], tuple(r["deleted"]), tuple(tuple(x) for x in r["runs"])) for r in lines.deletions(df).collect())


def test_deletions_equal_brute_force(spark, odd, no_docs):
    rng = random.Random(1)
    block = [f"line {i}" for i in range(40)]
    rows = [(50 + i, "\n".join(rng.choice(block[: 3 + i]) for _ in range(rng.randrange(1, 30))), "en", "a") for i in range(25)]
    rows += [(90, "\n".join(block), "en", "a"), (91, "\n".join(["x", *block, "y"]), "en", "a"), (92, "\n".join(["same"] * 9), "en", "a"), (93, "\n\n\n", "en", "a"), (20, "\n".join(block[5:20]), "en", "a")]
    rows += [(95, "\n".join(block), "en", "a"), (90, "\n".join(block), "en", "a"), *odd[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert result(df) == brute(rows)
    assert lines.report(no_docs).count() == 0
    cut = lines.clean(odd[0])
    assert cut.columns == odd[0].columns and cut.count() == len(odd[1])


def test_matches_of_every_length(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("ab") + " of five words here" for _ in range(rng.randrange(30)))) for i in range(12)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_runs_are_maximal(spark):
    a = [f"a{i}" for i in range(12)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["p", *a[2:9], "q", *a[10:12]])), (3, "\n".join(["r", *a[4:9], "q", a[10]]))]
    found = lines.runs(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    got = {(r["source_doc"], r["source_begin"], r["begin"], r["end"]) for r in found}
    assert got == {(1, 2, 1, 8), (1, 10, 9, 11), (2, 3, 1, 8)}


def test_one_long_line_goes_and_a_short_one_stays(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [("a", f"one\n{passage}\ntwo words"), ("b", f"{passage}\nthree\ntwo words"), ("c", passage), ("d", "Yes."), ("e", "Yes.")]
    got = {r["doc_id"]: r["text"] for r in lines.clean(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": rows[0][1], "b": "three\ntwo words", "c": "", "d": "Yes.", "e": ""}


def test_clean_keeps_first(spark):
    rows = [(1, "a\nb b b b\nc"), (2, "x\na\nb b b b\ny"), (3, None)]
    got = {r["doc_id"]: r["text"] for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb b b b\nc", 2: "x\ny", 3: None}
