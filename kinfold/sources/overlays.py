"""Overlays: enrichments, attested facts and rulings; as JSON files under a lock, and as append-only tables.

The tables are the native form: every change is a row more, and the view is the
last value of each key, so no update can be lost. The files are for exchange
with other tools and follow one rule: read, change and replace under a lock, or
refuse and leave every byte as it was.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.text import pair_id
from kinfold.schema import ATTESTED_FIELDS

VERSION = 1
MANAGED = ("contacts/unified-index.json", "contacts/merge-candidates.json", "contacts/merge-decisions.json", "contacts/attested.json")
WRITABLE = ("contacts", "imports", "profile")


class Refused(ValueError):
    """Input that is not what it should be; nothing was changed."""


# -- envelopes --------------------------------------------------------------------------------


def _payload(raw: dict, name: str, kind: type):
    version = raw.get("schemaVersion")
    if isinstance(version, (int, float)) and version > VERSION:
        raise Refused(f"schemaVersion {version} is newer than {VERSION}")
    if not isinstance(raw.get(name), kind):
        raise Refused(f'no "{name}" of the right kind in the envelope')
    return raw[name]


def entries(raw: object) -> dict:
    """The entries of an overlay, bare or in an envelope; none of anything that is no object."""
    if not isinstance(raw, dict):
        return {}
    if not raw.keys() & {"entries", "schemaVersion"}:
        return raw
    got = _payload(raw, "entries", dict)
    outside = [k for k in raw if ":" in k]
    if outside:
        raise Refused(f"keys outside of entries: {', '.join(outside)}")
    return got


def decisions(raw: object) -> list:
    """The rulings, bare or in an envelope; none where there is no file."""
    if isinstance(raw, list):
        return raw
    if not isinstance(raw, dict):
        return []
    if not raw.keys() & {"decisions", "schemaVersion"}:
        raise Refused("rulings must be a list or an envelope")
    return _payload(raw, "decisions", list)


def wrap(name: str, payload: object) -> dict:
    return {"schemaVersion": VERSION, name: payload}


def stamp(source: dict) -> dict:
    return {k: v for k, v in source.items() if k != "schemaVersion"} | {"schemaVersion": VERSION}


# -- files ------------------------------------------------------------------------------------


def replace_file(path: str | Path, content: str | Iterable[str]) -> None:
    """Replace a file whole: written beside it, part by part, synced, renamed; its mode stays."""
    path = Path(path)
    mode = path.stat().st_mode & 0o777 if path.exists() else 0o644
    fd, beside = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.writelines([content] if isinstance(content, str) else content)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(beside, mode)
        os.replace(beside, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(beside)
        raise


@contextlib.contextmanager
def locked(path: str | Path, wait: float = 15, pause: float = 0.025) -> Iterator[None]:
    """Hold ``path`` for one process: an advisory lock on the file ``path.lock``, which stays.

    The kernel lets go of it when its holder ends, however it ends, so there is
    nothing to take over and nobody can release another's. Who does not get it
    in time says so in ``path.lock-stalls`` and raises.
    """
    lock = Path(f"{path}.lock")
    until = time.monotonic() + wait
    with lock.open("a+") as held:
        while True:
            try:
                fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    with Path(f"{path}.lock-stalls").open("a") as f:
                        f.write(f"{os.getpid()}\n")
                    raise TimeoutError(f"{lock} is held by process {lock.read_text().strip() or 'unknown'}") from None
                time.sleep(pause)
        held.truncate(0)
        held.write(str(os.getpid()))
        held.flush()
        yield


def update(path: str | Path, change: Callable[[object], object], empty: object, check: Callable[[object], object]) -> None:
    """Read, change and replace a JSON file under its lock; a file that does not parse or check is left alone."""
    with locked(path):
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
        except FileNotFoundError:
            raw = empty
        except ValueError as e:
            raise Refused(f"{path} is no JSON: {e}") from e
        check(raw)
        replace_file(path, json.dumps(change(raw), indent=2, ensure_ascii=False) + "\n")


def attest(path: str | Path, key: str, **facts: object) -> None:
    """Set the facts given about a key; the others stay. A street address is no location."""
    from kinfold.functions.validate import STREET_SHAPES

    facts = {k: v for k, v in facts.items() if v is not None}
    if ":" not in key or not facts or not facts.keys() <= {*ATTESTED_FIELDS}:
        raise Refused("a key with a colon and at least one known fact are needed")
    if "location" in facts and re.search("|".join(STREET_SHAPES).replace(r"\p{L}", r"[^\W\d_]"), str(facts["location"]), re.I):
        raise Refused("a location is a city, not a street")

    def change(raw: object) -> dict:
        have = entries(raw)
        return wrap("entries", {**have, key: {**have.get(key, {}), **facts}})

    update(path, change, {}, entries)


def rule(path: str | Path, a: str, b: str, verdict: str) -> None:
    """Rule on a pair, in either order; an earlier ruling on it is replaced."""
    if ":" not in a or ":" not in b or verdict not in ("same", "different"):
        raise Refused("two keys with a colon and a verdict are needed")

    def change(raw: object) -> dict:
        have, new = decisions(raw), {"keys": [a, b], "verdict": verdict}
        at = next((i for i, d in enumerate(have) if sorted(d.get("keys", [])) == sorted((a, b))), len(have))
        return wrap("decisions", [*have[:at], {**(have[at] if at < len(have) else {}), **new}, *have[at + 1 :]])

    update(path, change, [], decisions)


def data_root(env: dict[str, str], name: str, engine: str | Path, cwd: str | Path) -> Path:
    """The data folder: ``env[name]``, absolute, there, and outside the engine; the working folder if it is not set."""
    if not env.get(name):
        return Path(cwd)
    root = Path(env[name])
    if not root.is_absolute() or not root.is_dir():
        raise Refused(f"{name} must be an absolute path of a folder")
    for at, tree in ((root, Path(engine)), (root.resolve(), Path(engine).resolve())):
        if at == tree or tree in at.parents:
            raise Refused(f"{name} must be outside of {engine}")
    return root


def writable(root: str | Path, target: str) -> Path:
    """A path under ``root`` that raw input may be written to."""
    path = (Path(root) / target).resolve()
    inside = Path(root).resolve()
    if os.path.isabs(target) or inside not in path.parents or path.relative_to(inside).parts[0] not in WRITABLE or path.relative_to(inside).as_posix() in MANAGED:
        raise Refused(f"{target} may not be written")
    return path


# -- tables -----------------------------------------------------------------------------------


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, v)`` of every entry of the overlay files at ``path``, values as VARIANT; broken files raise."""
    def of(row) -> Iterator[tuple[str, str, str]]:
        for k, v in entries(json.loads(row["value"])).items():
            yield row["file"], k, json.dumps(v)

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([x for r in frame.to_dict("records") for x in of(r)], columns=["file", "key", "json"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(run, "file string, key string, json string").select("file", "key", F.parse_json("json").alias("v"))


def append_log(rows: DataFrame, path: str) -> None:
    """Add changes to a log table; each has ``at``, when it was made."""
    rows.write.mode("append").parquet(path)


def last_wins(log: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """The last row of each key."""
    row = F.struct(*(c for c in log.columns if c != key))
    return log.groupBy(key).agg(F.max_by(row, at).alias("x")).select(key, "x.*")


def merged_facts(log: DataFrame) -> DataFrame:
    """Of each key, and each attested field, the last value given."""
    return log.groupBy("key").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in ATTESTED_FIELDS))


def rulings(log: DataFrame) -> DataFrame:
    """The last ruling on each pair of ``log(at, key_a, key_b, verdict)``, in the order in which pairs were first ruled on."""
    pair = pair_id(F.col("key_a"), F.col("key_b"))
    last = log.groupBy(pair.alias("pair")).agg(F.min("at").alias("first"), F.max_by(F.struct("key_a", "key_b", "verdict"), "at").alias("x"))
    return last.select("first", "x.*")


def publish(tables: dict[str, DataFrame], root: str, records: int) -> str | None:
    """Write index tables as a new version and point ``CURRENT`` at it in one rename; nothing if there are no records."""
    if not records:
        return None
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = path(f"{root}/.CURRENT.{version}")
    out = fs.create(beside)
    out.writeBytes(version)
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(path(f"{root}/CURRENT")), options)
    return version


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the published version, looked up anew on every call."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}/{table}")
