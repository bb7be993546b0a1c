import time
import json
import multiprocessing
import os

import pytest

from kinfold.sources import overlays as o


def test_envelopes():
    assert o.entries({"a:1": 1}) == {"a:1": 1} and o.entries([1]) == {} and o.entries(o.wrap("entries", {"a:1": 2})) == {"a:1": 2}
    assert o.decisions([1]) == [1] and o.decisions(None) == [] and o.decisions(o.wrap("decisions", [])) == []
    for bad in ({"entries": []}, {"schemaVersion": 2, "entries": {}}, {"entries": {}, "a:1": {}}):
        with pytest.raises(o.Refused):
            o.entries(bad)
    for bad in ({"x": 1}, {"decisions": {}}, {"schemaVersion": 9, "decisions": []}):
        with pytest.raises(o.Refused):
            o.decisions(bad)
    assert list(o.stamp({"schemaVersion": 7, "source": "a"}).items())[-1] == ("schemaVersion", 1)


def _many(path, worker):
    for i in range(25):
        o.attest(path, f"k:{worker}-{i}", context="c")


def test_no_update_is_lost(tmp_path):
    path = str(tmp_path / "attested.json")
    jobs = [multiprocessing.get_context("fork").Process(target=_many, args=(path, w)) for w in range(4)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert len(o.entries(json.loads((tmp_path / "attested.json").read_text()))) == 100
    assert sorted(os.listdir(tmp_path)) == ["attested.json", "attested.json.lock"]


def _hold(path, ready, seconds):
    with o.locked(path):
        ready.set()
        time.sleep(seconds)


def test_lock_of_a_dead_owner_is_free_and_of_a_living_one_is_not(tmp_path):
    path = tmp_path / "x.json"
    ctx = multiprocessing.get_context("fork")
    ready = ctx.Event()
    job = ctx.Process(target=_hold, args=(path, ready, 60))
    job.start()
    ready.wait(30)
    with pytest.raises(TimeoutError, match=str(job.pid)), o.locked(path, wait=0.05):
        pass
    assert (tmp_path / "x.json.lock-stalls").read_text() == f"{os.getpid()}\n"
    job.kill()
    job.join()
    o.rule(path, "a:1", "b:2", "same")
    assert path.exists()


def test_malformed_files_stay_as_they_are(tmp_path):
    path = tmp_path / "x.json"
    path.write_text("{broken")
    with pytest.raises(o.Refused):
        o.attest(path, "a:1", context="c")
    assert path.read_text() == "{broken"


def test_rulings_are_unordered_pairs_and_facts_merge(tmp_path):
    path = tmp_path / "r.json"
    o.rule(path, "a:1", "b:2", "same")
    o.rule(path, "b:2", "a:1", "different")
    assert [d["verdict"] for d in o.decisions(json.loads(path.read_text()))] == ["different"]
    facts = tmp_path / "f.json"
    o.attest(facts, "a:1", context="c")
    o.attest(facts, "a:1", relationship="r")
    assert o.entries(json.loads(facts.read_text())) == {"a:1": {"context": "c", "relationship": "r"}}
    for key, more in (("nokey", {"context": "x"}), ("a:1", {}), ("a:1", {"location": "12 Main Street"}), ("a:1", {"other": 1})):
        with pytest.raises(o.Refused):
            o.attest(facts, key, **more)


def test_paths(tmp_path):
    (tmp_path / "data").mkdir()
    engine = tmp_path / "engine"
    (engine / "in").mkdir(parents=True)
    assert o.data_root({}, "ROOT", engine, "/w").as_posix() == "/w"
    assert o.data_root({"ROOT": str(tmp_path / "data")}, "ROOT", engine, "/w") == tmp_path / "data"
    for bad in ("rel", str(engine / "in"), str(tmp_path / "none")):
        with pytest.raises(o.Refused):
            o.data_root({"ROOT": bad}, "ROOT", engine, "/w")
    assert o.writable(tmp_path, "imports/a.txt")
    for bad in ("../x", "/etc/x", "other/a", "contacts/attested.json", "imports/../../x"):
        with pytest.raises(o.Refused):
            o.writable(tmp_path, bad)


def test_publish_switches_whole_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    assert o.publish({"people": df}, root, 0) is None and os.listdir(root) == []
    o.publish({"people": df}, root, 3)
    o.publish({"people": spark.range(5)}, root, 5)
    assert o.current(spark, root, "people").count() == 5


def test_entries_as_a_table(spark, tmp_path):
    (tmp_path / "b1.json").write_text(json.dumps({"a:1": {"confidence": "low"}, "a:2": {"x": 1}}))
    (tmp_path / "b2.json").write_text(json.dumps(o.wrap("entries", {"a:1": {"confidence": "high", "employer": "unknown"}})))
    from kinfold.plans.queue import bank

    latest, tried = bank(o.read_entries(spark, str(tmp_path)))
    got = {r["key"]: (r["confidence"], r["employer"]) for r in latest.collect()}
    assert got == {"a:1": ("high", ""), "a:2": ("unidentified", "")}
    assert [r["key"] for r in tried.collect()] == ["a:1"]
