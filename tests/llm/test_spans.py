import random
import re
from collections import Counter

from kinfold.llm import spans

from .conftest import prose


def sentences(text):
    """Lists of words; a sentence ends with its sign or its line."""
    out = []
    for line in re.split("[\r\n]", text or ""):
        now = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            now.append(re.sub("[A-Z]", lambda m: m[0].lower(), word))
            if word[-1] in ".!?":
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


def brute(rows):
    last = float("inf")
    own, first = [], {}
    for d, t, *_ in rows:
        s, found = sentences(t), []
        for i in range(len(s)):
            n = 0
            for j in range(i, len(s)):
                n += len(s[j])
                if n >= spans.WORDS:
                    found.append((tuple(w for x in s[i : j + 1] for w in x), i, j))
                    break
        own.append((last if d is None else d, len(s), found))
        for k, i, _ in found:
            at = (own[-1][0], i)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for d, n, found in own:
        out[None if d == last else d, n, tuple(sorted({x for k, i, j in found if first[k] < (d, i) for x in range(i, j + 1)}))] += 1
    return out


def listed(s):
    return tuple(x for p in s.split(",") if p for a, b in [map(int, p.split("-"))] for x in range(a, b + 1))


def test_equals_brute_force(spark, odd, no_docs, monkeypatch):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (60, 75, 200, 30)] + ["one " * 60]
    rows = [(100 + i, f"{prose(rng, rng.randrange(5, 90))}.\n{rng.choice(passages)} {prose(rng, 20)}", "en", "a") for i in range(40)]
    rows += [(500, passages[0] + "\n" + passages[0], "en", "a"), *odd[1]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = brute(rows)
    for frequent in (spans.FREQUENT, 3):
        monkeypatch.setattr(spans, "FREQUENT", frequent)
        got = Counter((r["doc_id"], r["n_sentences"], listed(r["removed"])) for r in spans.report(df).collect())
        assert got == want
    assert spans.report(no_docs).count() == 0


def test_clean(spark, odd):
    rng = random.Random(2)
    passage = prose(rng, 54)
    rows = [(1, "First. " + passage + " Last."), (2, "Other one. " + passage + " Éther end."), (3, None), (4, "short. short. short.")]
    got = {r["doc_id"]: r["text"] for r in spans.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] is None and got[4] == rows[3][1]
    assert got[2] == "Other one. Éther end."
    cut = spans.clean(odd[0])
    assert cut.columns == odd[0].columns and cut.count() == len(odd[1])


def every_run(rows):
    """Removed sentences when every run of sentences of WORDS words and more is hashed, and shorter texts as a whole."""
    own, first = [], {}
    for d, t in rows:
        s = [tuple(x) for x in sentences(t)]
        size = [len(x) for x in s]
        found = [(tuple(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(size[i:j]) >= spans.WORDS or j - i == len(s)]
        own.append((d, found))
        for k, i, _ in found:
            first[k] = min(first.get(k, (d, i)), (d, i))
    return {d: tuple(sorted({x for k, i, j in found if first[k] < (d, i) for x in range(i, j)})) for d, found in own}


def test_ends_of_repeated_runs_go(spark, monkeypatch):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    passages = [f"{line(30)}.\n{line(24)}.\n", "".join(f"{line(n)}.\n" for n in (3, 26, 5, 4, 40, 9, 9)), "".join(f"{line(7)}.\n" for _ in range(9))]
    rows = [(i, f"{line(rng.randrange(1, 40))}.\n{rng.choice(passages)}{line(rng.randrange(1, 40))}.\n{rng.choice(passages)}{line(5)}.") for i in range(30)]
    rows += [(100, "Few words. Here."), (101, "few words. here."), (102, "few words."), (103, rows[0][1]), (104, passages[0] + passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = every_run(rows)
    assert want[101] == (0, 1) and not want[102] and len(want[103]) == len(sentences(rows[0][1]))
    for frequent in (spans.FREQUENT, 3):
        monkeypatch.setattr(spans, "FREQUENT", frequent)
        assert {r["doc_id"]: listed(r["removed"]) for r in spans.report(df, ends=True).collect()} == want
    assert {r["doc_id"]: r["text"] for r in spans.clean(df).collect()}[103] == ""
