"""The loops around an agent, with agents that are tables."""

import json

import pytest
from pyspark.sql import functions as F

from kinfold.plans import loop
from kinfold.plans.catalogue import part_people
from kinfold.sources.overlays import Refused, entries, locked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return part_people(spark, SF).limit(40).cache()


def prompts(units):
    """Units whose members are their first keys."""
    members = F.transform("members", lambda o: F.struct(F.concat(F.lit("part:"), o.cast("string")).alias("key"), F.lit("").alias("linkedinUrl")))
    return units.select(F.col("unit").cast("long").alias("unit"), members.alias("members"), F.lit("who?").alias("prompt"))


def agent(asked, limited=lambda unit, turn: False):
    """Answers every member; some units meet a limit at some turns."""
    def ask(units):
        rows, turn = units.collect(), len(asked)
        asked.append(sorted(r["unit"] for r in rows))
        out = []
        for r in rows:
            answers = [{"n": i + 1, "employer": f"E{r['unit']}", "confidence": "high"} for i in range(len(r["members"]))]
            text = json.dumps(answers if len(answers) > 1 else answers[0])
            hit = limited(r["unit"], turn)
            out.append((r["unit"], "" if hit else f"```json\n{text}\n```", not hit, hit))
        return units.sparkSession.createDataFrame(out, "unit long, output string, ok boolean, limit boolean")

    return ask


def nobody(spark):
    return spark.createDataFrame([], "key string")


def test_waves_are_banked_one_by_one_and_resumed(spark, people, tmp_path):
    asked, built = [], []
    run = loop.enrich(people, nobody(spark), agent(asked), prompts, tmp_path, limit=8, width=2, after=built.append)
    assert run.reason == "all done" and run.attempted == 8 == run.identified and len(run.files) == run.waves == len(built)
    assert sum(len(a) for a in asked) == len({u for a in asked for u in a}) and all(len(a) <= 2 for a in asked)
    keys = [k for f in run.files for k in entries(json.loads((tmp_path / f).read_text()))]
    assert len(keys) == 8 == len(set(keys))
    again = loop.enrich(people, spark.createDataFrame([(k,) for k in keys], "key string"), agent([]), prompts, tmp_path, limit=8, width=8)
    later = [k for f in again.files for k in entries(json.loads((tmp_path / f).read_text()))]
    assert len(later) == 8 and not set(later) & set(keys)


def test_a_limit_is_waited_for_and_ends_the_run_when_it_lasts(spark, people, tmp_path):
    asked, slept = [], []
    run = loop.enrich(people, nobody(spark), agent(asked, lambda unit, turn: unit == 1 and turn == 0), prompts, tmp_path / "a", limit=6, width=3, sleep=slept.append)
    assert run.reason == "all done" and run.attempted == 6 and asked[1] == [1] and len(slept) == 1 and 16 <= slept[0] <= 24
    asked, slept = [], []
    run = loop.enrich(people, nobody(spark), agent(asked, lambda unit, turn: unit == 1), prompts, tmp_path / "b", limit=6, width=2, retries=2, sleep=slept.append)
    assert "usage limit" in run.reason and run.waves == 1 and len(slept) == 2 and asked[1:] == [[1], [1]]
    assert run.files  # what the other unit said is kept


def test_stop_file_guard_and_single_run(spark, people, tmp_path):
    stop = tmp_path / "stop"
    stop.touch()
    assert loop.enrich(people, nobody(spark), agent([]), prompts, tmp_path / "a", limit=4, stop_file=stop).waves == 0
    said = iter([None, "the battery is low"])
    run = loop.enrich(people, nobody(spark), agent([]), prompts, tmp_path / "b", limit=8, width=1, check=lambda: next(said))
    assert run.waves == 1 and run.reason == "the battery is low"
    (tmp_path / "c").mkdir()
    with locked(tmp_path / "c" / ".run"), pytest.raises(TimeoutError):
        loop.enrich(people, nobody(spark), agent([]), prompts, tmp_path / "c")
    assert loop.guard(None) is None and loop.guard(["true"]) is None and loop.guard(["sh", "-c", "echo low; exit 3"]) == "low" and "could not" in loop.guard(["/no/such"])
    assert loop.listing(loop.candidates(people, nobody(spark)), 3).count() == 20


def thin(spark, n):
    rows = [(i, f"Ann Lee {chr(97 + i)}", [f"fb:{i}"], ["facebook"]) for i in range(n)]
    df = spark.createDataFrame(rows, "first_ord long, name string, keys array<string>, sources array<string>")
    blank = [F.lit("").alias(c) for c in ("employer", "profession", "linkedinUrl")]
    return df.select("*", *blank, F.lit(None).cast("struct<relationship:string>").alias("attested"), F.lit(None).cast("struct<confidence:string>").alias("enrichment"), F.expr("map('facebook', '2001-01-01')").alias("connectedOn"))


def cues(fail=()):
    def ask(units):
        out = []
        for r in units.collect():
            bad = any(k in fail for k in r["keys"])
            said = [{"n": i + 1, "verdict": "yes" if k.endswith(("0", "3")) else "no", "evidence": f"saw {k}"} for i, k in enumerate(r["keys"])]
            out.append((r["unit"], f"```json\n{json.dumps(said)}\n```" if not bad else "", not bad, False))
        return units.sparkSession.createDataFrame(out, "unit long, output string, ok boolean, limit boolean")

    return ask


def test_cues_are_proposed_retried_and_applied(spark, tmp_path):
    people, path, facts = thin(spark, 7), tmp_path / "p.json", tmp_path / "attested.json"
    with pytest.raises(Refused):
        loop.propose(people, cues(), path, retry_failed=True)
    got = loop.propose(people, cues(fail=["fb:5"]), path, "class of 2001", "classmate", size=2, width=2)
    assert [p["key"] for p in got["yes"]] == ["fb:0", "fb:3"] and {p["key"] for p in got["unsure"]} == {"fb:4", "fb:5"}
    assert json.loads(path.read_text())["complete"]
    with pytest.raises(Refused):
        loop.propose(people, cues(), path, "x", "y")
    again = loop.propose(people, cues(), path, retry_failed=True)
    said = json.loads(path.read_text())
    assert not again["unsure"] and len(said["proposals"]) == 7 and said["tag"] == "classmate"
    facts.write_text(json.dumps({"fb:0": {"location": "Springfield"}}))
    assert loop.apply(path, facts, day="2024-05-01") == ["fb:0", "fb:3"] and not path.exists()
    have = entries(json.loads(facts.read_text()))
    assert have["fb:0"] == {"location": "Springfield", "relationship": "classmate", "context": "class of 2001. Cue-checked (saw fb:0), owner-confirmed 2024-05-01.", "corroboration": "web"}
    loop.propose(people, cues(), path, "c", "t")
    assert loop.apply(path, facts, "fb:1, fb:2") == ["fb:1", "fb:2"]
    loop.propose(people, cues(), path, "c", "t")
    with pytest.raises(Refused):
        loop.apply(path, facts, "no:1")


def test_reports(spark, people):
    warnings = spark.createDataFrame([("names differ",)], "kind string")
    records = spark.createDataFrame([("a", ["x"], [], {"h": "1"}, "E"), ("a", [], ["1"], {}, ""), ("b", [], [], {}, None)], "source string, emails array<string>, phones array<string>, handles map<string,string>, employer string")
    found = spark.createDataFrame([("fuzzy",), ("exact-name",), ("exact-name",)], "reason string")
    rows = {(r["kind"], r["value"]): r["n"] for r in loop.build_report(records, people, found, warnings).collect()}
    assert rows["records", "a"] == 2 and rows["people", "all"] == 40 and rows["candidates", "exact-name"] == 2 and rows["warnings", "names differ"] == 1
    assert rows["people", "several sources"] == sum(len(r["sources"]) > 1 for r in people.collect())
    by = {r["source"]: r.asDict() for r in loop.import_report(records, warnings).collect()}
    assert by["a"] == {"source": "a", "records": 2, "with_email": 1, "with_phone": 1, "with_handle": 1, "with_employer": 1, "warnings": 1}
    assert loop.exact_names(found).first().asDict() == {"exact_names": 2, "candidates": 3}
    state = loop.status(people, spark.createDataFrame([("part:1", "2024-01-01")], "key string, enrichedAt string")).first()
    assert state["attempted"] == 1 and state["last_at"] == "2024-01-01" and state["people"] == 40 and state["backlog"] > 0
    lines = loop.print_hits(spark, people, 3)
    assert len(lines) == 5 and lines[-2:] == ["(37 more)", "40 match(es)"]
