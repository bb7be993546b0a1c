import hashlib
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from kinfold.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract's patterns as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a1.@-+%( )é9 0") , max_size=40))
@example("a@b.c%d@e.f x@y @z.q a@@b.c")
@example("1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1")
@example("4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-6789 +1-(2")
def test_base_spans_equal_the_patterns(text):
    assert privacy.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "@" * 100_000, "a@" * 50_000):
        privacy.base_spans(text)


def test_odd_rows(spark, odd, no_docs):
    df, rows = odd
    got = privacy.report(df).collect()
    assert len(got) == len(rows)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert privacy.report(no_docs).count() == 0
    assert privacy.sanitise(df).columns == df.columns


def test_terms_that_disclose(spark):
    rng = ["amber river stone", "quiet garden morning", "winter ledger marble", "hollow orchard light"]
    rows = [(i, f"{a} Zyxworth Quill zq@example.com {b} the") for i, (a, b) in enumerate(zip(rng, rng[1:] + rng[:1], strict=True))]
    rows += [(100 + i, f"{a} the other text {b}") for i, (a, b) in enumerate(zip(rng, rng[::-1], strict=True))]
    rows += [(200 + i, "copied Vandermeer text cp@example.com with the same words all around") for i in range(9)]
    rows += [(300, "later on Zyxworth came alone"), (301, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in privacy.report(df).collect()}
    assert got[0]["n_email"] == 1 and got[0]["spans"].count("term:") == 2  # Zyxworth and Quill, not the
    text = rows[0][1]
    a = text.index("Zyxworth")
    assert f"term:{a}:{a + 8}" in got[0]["spans"]
    assert got[300]["spans"] == "term:9:17" and got[300]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "term" not in got[200]["spans"] and got[100]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert "zq@" not in clean[0] and "<email>" in clean[0] and "Quill" not in clean[0] and clean[301] is None
    assert clean[100] == rows[4][1]


def test_codes_and_what_announces_them(spark):
    near = ["amber river stone", "quiet garden morning", "winter ledger marble", "hollow orchard light"]
    rows = [(i, f"{a} the passkey = \"{i}f{'a1b2c3d4' * 4}\" the {b}") for i, (a, b) in enumerate(zip(near, near[1:] + near[:1], strict=True))]
    rows += [(10, "the words of the text 1234567890123456789 abcdefghijklmnopqrstuvw éa1b2c3d4a1b2c3d4 the"), (11, "the other key")]
    got = {r["doc_id"]: r for r in privacy.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        a, b = rows[i][1].index('"') + 1, rows[i][1].rindex('"')
        c = rows[i][1].index("passkey")
        assert got[i]["spans"] == f"term:{c}:{c + 7},term:{a}:{b}" and got[i]["n_term"] == 2
    assert got[10]["n_term"] == 0 and got[11]["n_term"] == 0


def test_windows_hold_whole_terms():
    text = "x" * 1000 + " " + "y" * 900 + " a@b.cd " + "z" * 1000
    (_, left, right), = privacy._near(text, privacy.base_spans(text))
    assert left.split() == ["x" * 1000, "y" * 900] and right.split() == ["z" * 1000]


def test_long_texts_are_searched_whole(spark):
    text = "river stone " * 30_000 + "me@example.com and 10.0.0.1 " + "light " * 30_000 + "+1 (234) 555-6789"
    r = privacy.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)


def test_repeated_rows_count_each(spark):
    near = ["amber river stone", "quiet garden morning", "winter ledger marble"]
    rows = [(i, f"{a} Vandermeer vm@example.com {a[::-1]}") for i, a in enumerate(near)]
    got = privacy.report(spark.createDataFrame(rows * 3, "doc_id long, text string")).collect()
    assert len(got) == 9 and {r["n_term"] for r in got} == {1}
