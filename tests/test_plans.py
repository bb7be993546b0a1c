"""Serving, queues and answers, with what must never leave."""

import io
import json
import re

import pytest
from pyspark.sql import functions as F

from kinfold.plans import catalogue, queue, search, serve
from kinfold.sources.exports import follow_graph, normalized, paged, read_exports, read_normalized
from kinfold.streaming import bank

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return catalogue.part_people(spark, SF).withColumn("unlisted", F.lit("LEAK")).withColumn("addresses", F.array(F.lit("12 Main Street LEAK")))


def test_served_records_hold_only_what_is_listed(people):
    rows = [r[0] for r in serve.served(people).select(F.to_json(F.struct("*"))).collect()]
    assert not [r for r in rows if "LEAK" in r or "Secret" in r or "Refused" in r or "unconfirmed" in r]
    one = json.loads(next(r for r in rows if json.loads(r)["id"] == "p9"))
    assert "notes" not in one["enrichment"]  # p9 has a refused employer
    six = json.loads(next(r for r in rows if json.loads(r)["id"] == "p6"))
    assert six["attested"] == {"relationship": "friend", "context": six["name"], "domains": ["x"]}


def test_exports_and_briefs_do_not_leak(people):
    blocks, skipped = serve.knowledge(people)
    text = "\n".join(r["block"] for r in blocks.collect()) + "\n".join(r["b"] for r in people.select(serve.brief().alias("b")).collect())
    assert "LEAK" not in text and "Secret" not in text and "Refused" not in text and skipped.count() == 0


def test_tools_over_messages(people, tmp_path):
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    calls = [
        ask("initialize"), ask("ping"), ask("tools/list"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, [1], ask("nope"),
        ask("tools/call", name="search_contacts", arguments={"query": "town", "limit": 99}), ask("tools/call", name="search_contacts", arguments={}),
        ask("tools/call", name="get_contact", arguments={"key": "part:6"}), ask("tools/call", name="get_contact", arguments={"name": "zzz"}), ask("tools/call", name="get_contact", arguments={"name": " "}), ask("tools/call", name="contact_stats"),
    ]
    out = io.StringIO()
    serve.serve(lambda: people, io.StringIO("\n".join(map(json.dumps, calls)) + "\n{broken\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == len(calls)  # one notification unanswered, one broken line answered
    said = lambda i: got[i]["result"]["content"][0]["text"]
    assert got[0]["result"]["protocolVersion"] == serve.PROTOCOL and len(got[2]["result"]["tools"]) == 3
    assert got[3]["error"]["code"] == -32600 and got[4]["error"]["code"] == -32601 and got[-1]["error"]["code"] == -32700
    assert "200 match(es) (showing 25)" in said(5) and said(5).count("\n") == 25 + 3 and got[6]["result"]["isError"]
    assert '"key' in said(7) and "LEAK" not in out.getvalue() and "Secret" not in out.getvalue()
    assert said(8).startswith("No contact matching") and got[9]["result"]["isError"] and said(10).startswith("200 contacts.")


def test_knowledge_file(people, tmp_path):
    n = serve.write_knowledge(people, str(tmp_path / "k.md"), "2024-01-01")
    text = (tmp_path / "k.md").read_text()
    assert n == 200 and text.count("\n## ") == 200 and "exported 2024-01-01" in text


def test_limits():
    assert [search.clamp(x) for x in (None, "x", -1, 0, 7, 99, float("nan"))] == [15, 15, 15, 15, 7, 25, 15]


def test_empty_query_matches_all_and_words_are_anded(people):
    assert search.search(people).count() == 200
    assert search.search(people, "town nosuchword").count() == 0


def test_prompts_keep_private_facts_out_of_groups(people):
    rows = people.where("first_ord = 6").select(queue.block(True).alias("c"), queue.block(False).alias("s")).first()
    assert "friend" not in rows["c"] and "example.com" not in rows["c"].replace("site", "") and "Town" not in rows["c"] and "- linkedin:" in rows["c"]
    assert "friend" in rows["s"] and "Town" in rows["s"]
    assert "PRIOR" in queue.prompt(["a"], "PRIOR") and "PRIOR" not in queue.prompt(["a", "b"], "PRIOR")
    with pytest.raises(ValueError):
        queue.of_kind(people, "x")


def test_answers_go_to_the_member_they_name(spark):
    rows = [
        (1, [("a:1", "")], '```json\n{"confidence":"high","employer":"X"}\n```'), (2, [("b:1", ""), ("b:2", "")], '[{"n":1,"confidence":"low"},{"n":2,"confidence":"low"},{"n":2,"confidence":"high"}]'),
        (3, [("c:1", "https://linkedin.com/in/q"), ("c:2", "")], '```\n{"results":[{"n":1,"linkedinUrl":"https://linkedin.com/in/other","confidence":"high"},{"n":9,"confidence":"low"},{"n":1.5}]}\n```'), (4, [("d:1", "")], "no json"),
    ]
    df = spark.createDataFrame(rows, "unit long, members array<struct<key string, linkedinUrl string>>, output string")
    got = {r["key"]: r["result"]["confidence"] if r["result"] else None for r in queue.answers_of(df).collect()}
    # a list without a fence is no block of braces, so unit 2 has no answers
    assert got == {"a:1": "high", "b:1": None, "b:2": None, "c:1": None, "c:2": None, "d:1": None}
    fenced = df.where("unit = 2").withColumn("output", F.concat(F.lit("```json"), "output", F.lit("```")))
    assert {r["key"]: bool(r["result"]) for r in queue.answers_of(fenced).collect()} == {"b:1": True, "b:2": False}


def test_verdicts_take_the_last(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], '```json\n[{"n":1,"verdict":"no"},{"n":1,"verdict":"yes","evidence":"e"},{"n":2,"verdict":"sure"}]\n```')], "batch long, keys array<string>, output string")
    assert {r["key"]: (r["verdict"], r["evidence"]) for r in queue.verdicts(df).collect()} == {"a": ("yes", "e"), "b": ("unsure", ""), "c": ("unsure", "")}


def test_agent_outcomes(spark):
    assert queue.outcome(0, "", "429", True) == (True, False, False) and queue.outcome(75, "", "", False) == (False, True, True)
    assert queue.outcome(1, "rate limit", "", True)[1] and not queue.outcome(1, "rate limit", "", False)[1]
    assert queue.agent_args('["a b", 1]') == ["a b", "1"] and queue.agent_args("[oops") is None and queue.agent_args(" a  b ") == ["a", "b"]
    assert 16 <= queue.backoff(0) <= 24 and 144 <= queue.backoff(9) <= 216
    df = spark.createDataFrame([(1, "hello"), (2, "x")], "unit long, prompt string")
    got = {r["unit"]: (r["output"], r["ok"]) for r in queue.ask(df, ["cat"]).collect()}
    assert got == {1: ("hello", True), 2: ("x", True)}


def test_export_files_become_ordered_records(spark, tmp_path):
    (tmp_path / "b.csv").write_text("First Name,Last Name,URL\nAnn,Lee,\n,,https://x\n")
    (tmp_path / "a.csv").write_text("First Name,Last Name,URL\nBob,Moe,\nCy,Poe,\n")
    rows, warnings = read_exports(spark, str(tmp_path), "linkedin")
    assert [(r["ord"], r["key"]) for r in rows.orderBy("ord").collect()] == [(0, "linkedin:bob-moe"), (1, "linkedin:cy-poe"), (2, "linkedin:ann-lee")]
    assert warnings.count() == 1


def test_normalized_files_with_junk(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": "gmail", "records": [{"sourceId": "1", "emails": ["a@x.com", 7, None], "handles": {"x": None, "y": "h"}, "addresses": [{"city": "Reno"}]}, {"name": "no id"}, {"sourceId": "2", "key": "own:2", "source": "own"}]}))
    (tmp_path / "b.json").write_text('{"records": 3}')
    rows, warnings = read_normalized(spark, str(tmp_path))
    got = rows.orderBy("ord").collect()
    assert [(r["ord"], r["key"], r["source"]) for r in got] == [(0, "gmail:1", "gmail"), (2, "own:2", "own")]
    assert got[0]["emails"] == ["a@x.com"] and got[0]["handles"] == {"y": "h"} and got[0]["addresses"][0]["city"] == "Reno"
    assert sorted(r["warning"] for r in warnings.collect()) == ["emails: 7", "emails: null", "no source or no records", "record without sourceId"]


def test_follow_graph_and_pages(spark):
    actor = "pos long, did string, handle string, displayName string, description string"
    a = spark.createDataFrame([(0, "did:a", "a.x", " Ann ", "bio"), (1, None, "z", "", ""), (2, "did:b", "handle.invalid", "", "")], actor)
    b = spark.createDataFrame([(0, "did:a", "other", "", ""), (1, "did:c", "c.x", "", "")], actor)
    rows, warnings = follow_graph(a, b)
    assert {r["did"]: (r["name"], r["edge"], r["handles"]) for r in rows.collect()} == {"did:a": ("Ann", "mutual", {"bluesky": "a.x"}), "did:b": ("handle.invalid", "following", {}), "did:c": ("c.x", "follower", {"bluesky": "c.x"})}
    assert warnings.count() == 1
    tries = []

    def fetch(cursor):
        tries.append(cursor)
        if len(tries) in (1, 3):
            raise OSError("busy")
        return {"x": [1, 2], "cursor": "n"} if cursor is None else {"x": [3]}

    assert list(paged(fetch, "x")) == [1, 2, 3] and tries == [None, None, "n", "n"]


def test_bank_stream_takes_only_what_is_new(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("bank", "out", "chk"))
    (tmp_path / "bank").mkdir()
    row = lambda k, c="low": json.dumps({"key": k, "confidence": c, "enrichedAt": "2024-01-01T00:00:00Z"})
    (tmp_path / "bank/1.json").write_text("\n".join((row("a"), row("a"), row("b"), row("c", None))))
    bank.take_new(spark, src, out, chk)
    (tmp_path / "bank/2.json").write_text("\n".join((row("a"), row("d"))))
    bank.take_new(spark, src, out, chk)
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "d"]


def test_a_late_answer_is_an_attempt_too(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("bank", "out", "chk"))
    for day in ("2024-06-01", "2024-01-01", "2024-06-02"):
        spark.createDataFrame([(day, "high", f"{day} 10:00:00", "{}"), ("same", "low", f"{day} 10:00:00", "{}")], bank.SCHEMA).write.mode("append").json(src)
        bank.take_new(spark, src, out, chk)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["key"] for r in rows) == ["2024-01-01", "2024-06-01", "2024-06-02", "same"]


def test_an_agents_errors_are_redacted_and_its_limits_read(spark):
    units = spark.createDataFrame([(1, "hello")], "unit long, prompt string")
    command = ["sh", "-c", "echo 'password: hunter22 usage limit reached' >&2; exit 1"]
    told = queue.ask(units, command, default_agent=True).first()
    assert "hunter22" not in told["error"] and told["limit"] and not told["explicit"] and not told["ok"]
    assert not queue.ask(units, command).first()["limit"]
    assert queue.agent({}, ["x"]) == (["x"], True) and queue.agent({"AGENT_COMMAND": "y", "AGENT_ARGS": '["-p", "a b"]'}, ["x"]) == (["y", "-p", "a b"], False)


def test_a_malformed_file_is_told(spark, tmp_path):
    from kinfold.sources.exports import read_normalized

    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text('{"source": "s", "records": [{"sourceId": "1", "name": "Ann"}]}')
    records, warnings = read_normalized(spark, str(tmp_path))
    assert [r["key"] for r in records.collect()] == ["s:1"] and [r["warning"] for r in warnings.collect()] == ["no JSON"]


def test_records_of_a_file_do_not_carry_the_file(spark):
    """what goes beside each record of a normalized file is the file's name and source."""
    text = json.dumps({"source": "src", "records": [{"sourceId": str(i), "name": "Ann"} for i in range(50)]})
    records, _ = normalized(spark.createDataFrame([("f", text)], "file string, value string"))
    assert records.count() == 50
    plan = records._jdf.queryExecution().optimizedPlan()
    made = []
    while plan is not None:
        if plan.nodeName() == "Generate":
            made.append(plan.requiredChildOutput().mkString(","))
        plan = plan.children().head() if plan.children().size() else None
    assert made and not any(re.search(r"\bv#", x) for x in made), made
