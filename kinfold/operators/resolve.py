"""Resolution: which records are one person, which pairs a human should rule on.

The order of phases is part of the meaning: strong identifiers, rulings, then
deferred collisions, then similar names. Similar names are decided greedily, so
that a ruling "different" keeps whole people apart whatever joined them before.
Everything that can touch each other is one component of the graph of all
edges; components are found by the cluster, and inside each a small kernel
replays the decisions in order. It reads them as they come, sorted by the
cluster, and holds the forest of people and one block of names, never the
component's edges; rulings that repeat another come once, with their number.
Names are compared once for each pair of distinct names; records of one name
are tied by a star, and the kernel meets groups of records and kinds of record,
so no table of record pairs is made anywhere. Records that nothing ties to
another never get there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import attrgetter, itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.functions.names import EMPLOYER_WORDS, field_tokens, match_tokens, normalize_name, tokens_of
from kinfold.operators.components import connected_components
from kinfold.operators.identifiers import star_edges
from kinfold.session import written

MAYBE, SURE = 0.8, 0.9
STRONG, RULING, DEFERRED, MATCH, NAMES = range(5)
#: Rows that the kernel gives at once.
BATCH = 10_000


def _named(records: DataFrame) -> DataFrame:
    """``(ord, source, employer, norm, last)`` of the records that have a name."""
    rows = records.select("ord", "source", "employer", normalize_name(F.col("name")).alias("norm")).where("norm <> ''")
    return rows.withColumn("last", F.substring_index("norm", " ", -1))


def near_names(names: DataFrame) -> DataFrame:
    """``(na, nb, score, n)``: ordered pairs of distinct ``names(norm, last)`` that match at least ``MAYBE``, each with itself too; ``n`` tokens in ``na``.

    Names of one last token match so well only if another token of one begins
    like some token of the other: like another token of it, by which they are
    joined, or like the last token, which few names do.
    """
    rows = names.select("norm", "last").distinct().withColumn("tokens", tokens_of(F.col("norm")))
    others = F.transform(F.slice("tokens", F.lit(1), F.size("tokens") - 1), lambda t: F.substring(t, 1, 1))
    rows = rows.withColumn("letters", F.array_distinct(others))
    side = lambda df, x: df.select(F.col("last"), *(F.col(c).alias(f"{c}_{x}") for c in ("norm", "tokens")), *(["letter"] if "letter" in df.columns else []))
    by_letter = rows.withColumn("letter", F.explode("letters"))
    odd = rows.where(F.array_contains("letters", F.substring("last", 1, 1)))
    met = side(by_letter, "a").join(side(by_letter, "b"), ["last", "letter"]).drop("letter")
    met = met.unionByName(side(odd, "a").join(side(rows, "b"), "last")).unionByName(side(rows, "a").join(side(odd, "b"), "last"))
    scored = met.where("norm_a <> norm_b").withColumn("score", match_tokens(F.col("tokens_a"), F.col("tokens_b"))).where(F.col("score") >= MAYBE)
    own = rows.select(F.col("norm").alias("na"), F.col("norm").alias("nb"), F.lit(1.0).alias("score"), F.size("tokens").alias("n"))
    return scored.select(F.col("norm_a").alias("na"), F.col("norm_b").alias("nb"), "score", F.size("tokens_a").alias("n")).distinct().unionByName(own)


def ruling_edges(records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rulings(pos, i, j, verdict), unknown(pos, key_a, key_b))``; of records with one key the last is meant."""
    keys = records.groupBy("key").agg(F.max("ord").alias("ord"))
    a, b = keys.select(F.col("key").alias("key_a"), F.col("ord").alias("i")), keys.select(F.col("key").alias("key_b"), F.col("ord").alias("j"))
    joined = decisions.join(a, "key_a", "left").join(b, "key_b", "left")
    known = F.col("i").isNotNull() & F.col("j").isNotNull()
    return joined.where(known).select("pos", "i", "j", "verdict"), joined.where(~known).select("pos", "key_a", "key_b")


class Member(NamedTuple):
    """A record as the pass over similar names sees it; records that differ in ``ord`` alone are alike to all others."""

    block: int
    ord: int
    source: str
    name: str
    tokens: frozenset
    has: bool
    once: bool

    @property
    def kind(self) -> tuple:
        return self[2:]


class People:
    """The groups of one component, and which of them rulings keep apart."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.foes: dict[int, set[int]] = {}  # for each root those that rulings keep apart from it

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i == j:
            return
        self.up[j] = i
        for x in self.foes.pop(j, ()):
            self.foes[x].discard(j)
            if x != i:
                self.foes[x].add(i)
                self.foes.setdefault(i, set()).add(x)

    def part(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.foes.setdefault(i, set()).add(j)
            self.foes.setdefault(j, set()).add(i)

    def apart(self, i: int, j: int) -> bool:
        return self.find(j) in self.foes.get(self.find(i), ())


def similar(people: People, told: set, members: list[Member], near: dict[tuple[str, str], tuple[float, int]]) -> Iterator[tuple]:
    """Join the similar names of one block, record by record, and tell the candidates: ``(i, j, score, exact)``.

    What a record meets in a group is decided by the first later record of each
    kind there, so groups are met and not records, and a record is passed over
    when one of its kind and group has met all that it could meet.
    """
    numbers: dict[tuple, int] = {}
    kinds_of = [numbers.setdefault(m.kind, len(numbers)) for m in members]
    every = list(numbers)
    relations: list[dict[int, tuple | None]] = [{} for _ in every]

    def relation(x: int, y: int) -> tuple | None:
        if y not in relations[x]:
            a, b = every[x], every[y]
            found = near.get((a[1], b[1])) if a[0] != b[0] else None
            if found:
                score, n = found
                shared = not a[2].isdisjoint(b[2])
                found = score >= SURE and shared, score, score == 1 and n >= 2 and a[4] and b[4] and (shared or not (a[3] and b[3]))
            relations[x][y] = found
        return relations[x][y]

    held: dict[int, dict[int, list[int]]] = {}
    for m, kind in zip(members, kinds_of, strict=True):
        held.setdefault(people.find(m.ord), {}).setdefault(kind, []).append(m.ord)
    joins, met = 0, {}
    for m, kind in zip(members, kinds_of, strict=True):
        i = m.ord
        own = people.find(i)
        if met.get((kind, own)) == joins:
            continue
        events = []
        for root, kinds in held.items():
            if root == own:
                continue
            first: dict[bool, tuple] = {}  # the first later record that joins, and the first that may
            for other, ords in kinds.items():
                rel = relation(kind, other)
                if rel and (at := bisect_right(ords, i)) < len(ords) and (rel[0] not in first or ords[at] < first[rel[0]][0]):
                    first[rel[0]] = ords[at], root, rel
            events += first.values()
        for j, root, (sure, score, exact) in sorted(events):
            # the roots of ruled pairs are those of now: what is one person changes as names are joined
            if people.find(j) == own or people.apart(i, j):
                continue
            if sure:
                people.join(i, j)
                joins += 1
                for other, ords in held.pop(root).items():
                    held[own][other] = sorted(held[own].get(other, []) + ords)
            elif (pair := _pair(own, root)) not in told:
                told.add(pair)
                yield i, j, score, exact
        met[kind, own] = joins


def _pair(i: int, j: int) -> tuple[int, int]:
    return (i, j) if i < j else (j, i)


class Step(NamedTuple):
    """A row of a component: an edge, a pair of names that match, or a record's name."""

    phase: int
    s1: int = 0
    s2: int = 0
    s3: int = 0
    i: int = 0
    j: int = 0
    score: float | None = None
    type: str | None = None
    value: str | None = None
    verdict: str | None = None
    source: str | None = None
    name: str | None = None
    other: str | None = None
    tokens: Iterable[str] = ()
    has: bool | None = None
    once: bool | None = None
    n: int | None = None


def decide(steps: Iterable[Step]) -> Iterator[tuple[str, int, int, dict]]:
    """Decide one component: ``(kind, i, j, edge)`` of groups, candidates and conflicts.

    ``steps`` come by phase, rulings "different" after "same", then by ``s1``,
    ``s2``, ``s3``; they are read once, and of them only the names of a block
    are held at a time. A conflict's ``s1`` is how many rulings say it.
    """
    people, told, near, known = People(), set(), {}, {}
    for phase, part in groupby(steps, key=attrgetter("phase")):
        if phase == NAMES:
            for block, rows in groupby(part, key=attrgetter("s1")):
                # one object for equal texts and sets of tokens, however many records have them
                kept = lambda x: known.setdefault(x, x)
                members = [Member(block, e.i, kept(e.source), kept(e.name), kept(frozenset(e.tokens)), e.has, e.once) for e in rows]
                for i, j, score, exact in similar(people, told, members, near):
                    yield "candidate", i, j, {"phase": NAMES, "s1": block, "s2": i, "s3": j, "score": score, "exact": exact}
            continue
        for e in part:
            if phase == MATCH:
                near[e.name, e.other] = e.score, e.n
            elif phase == STRONG or (phase == RULING and e.verdict == "same"):
                people.join(e.i, e.j)
            elif phase == RULING and e.verdict == "different":
                people.part(e.i, e.j)
                if people.find(e.i) == people.find(e.j):
                    yield "conflict", e.i, e.j, {"s1": e.n}
            elif phase == DEFERRED:
                i, j = people.find(e.i), people.find(e.j)
                if i != j and not people.apart(i, j) and (pair := _pair(i, j)) not in told:
                    told.add(pair)
                    yield "candidate", e.i, e.j, {"phase": DEFERRED, "s1": e.s1, "s2": e.s2, "s3": e.s3, "score": e.score, "exact": False, "type": e.type, "value": e.value}
    for x in sorted(people.up):
        yield "group", x, people.find(x), {}


def replay(edges: list[dict], members: list[Member], near: dict[tuple[str, str], tuple[float, int]]) -> Iterator[tuple[str, int, int, dict]]:
    """:func:`decide` for a component at hand, in any order."""
    steps = [Step(**{c: e[c] for c in Step._fields if c in e}) for e in edges]
    steps = [e if e.n else e._replace(n=1) for e in sorted(steps, key=lambda e: (e.phase, e.verdict == "different", *e[1:4]))]
    steps += [Step(MATCH, name=a, other=b, score=score, n=n) for (a, b), (score, n) in near.items()]
    steps += [Step(NAMES, m.block, i=m.ord, source=m.source, name=m.name, tokens=m.tokens, has=m.has, once=m.once) for m in sorted(members)]
    return decide(steps)


DECIDED = pa.schema([("kind", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("s3", pa.int64()), ("phase", pa.int32()), ("score", pa.float64()), ("exact", pa.bool_()), ("type", pa.string()), ("value", pa.string())])


def decided(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decisions of each component in ``batches`` of ``(ci, *Step)``, a component's rows side by side and in order."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), DECIDED, strict=True)], schema=DECIDED)

    out = []
    for _, own in groupby(rows(), key=itemgetter(0)):
        for kind, i, j, e in decide(Step._make(r[1:]) for r in own):
            out.append((kind, i, j, e.get("s1"), e.get("s2"), e.get("s3"), e.get("phase"), e.get("score"), e.get("exact", False), e.get("type"), e.get("value")))
            if len(out) == BATCH:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def resolve(records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(groups, candidates, warnings)`` for ``records`` with a unique ``ord`` and ``decisions``.

    ``groups(ord, root)``: ``root`` is the first record of the person.
    ``candidates``: pairs to rule on, in order of ``seq``. Empty tables give
    groups of one record each.
    """
    star = star_edges(records)
    zero = F.lit(0).cast("long")
    empty = {"score": "double", "type": "string", "value": "string", "verdict": "string", "source": "string", "name": "string", "other": "string", "tokens": "array<string>", "has": "boolean", "once": "boolean", "n": "int"}

    def shaped(df: DataFrame, phase: Column, **values: Column) -> DataFrame:
        order = {"s1": zero, "s2": zero, "s3": zero, "i": zero, "j": zero}
        return df.select(phase.cast("int").alias("phase"), *(values.get(c, v).cast("long").alias(c) for c, v in order.items()), *(values.get(c, F.lit(None)).cast(k).alias(c) for c, k in empty.items()))

    col = F.col
    strong = shaped(star, F.when(col("kind") == "deferred", DEFERRED).otherwise(STRONG), s1=col("ord"), s2=col("rank"), s3=col("at"), i=col("holder"), j=col("ord"), score=F.lit(0.0), type=col("type"), value=col("value"))
    rulings, unknown = ruling_edges(records, decisions)
    # a ruling said again decides nothing; only how often one conflicts is told
    rulings = rulings.groupBy("i", "j", "verdict").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    ruled = shaped(rulings, F.lit(RULING), s1=col("pos"), i=col("i"), j=col("j"), verdict=col("verdict"), n=col("n"))
    rows = written(_named(records), "named")
    near = written(near_names(rows), "near")
    first = rows.groupBy("norm").agg(F.min("ord").alias("first"))
    blocks = rows.groupBy("last").agg(F.min("ord").alias("block"))
    once = rows.groupBy("source", "norm").agg((F.count("*") == 1).alias("once"))
    # a star for each name and an edge for each pair of names: never pairs of records
    stars = rows.join(first, "norm").where("ord <> first").select(col("first").alias("i"), col("ord").alias("j"))
    ends = first.withColumnsRenamed({"norm": "na", "first": "i"}), first.withColumnsRenamed({"norm": "nb", "first": "j"})
    links = near.where("na <> nb").join(ends[0], "na").join(ends[1], "nb").select("i", "j")
    edges = strong.unionByName(ruled)
    joins = edges.where("verdict is null or verdict = 'same'").select("i", "j").unionByName(stars).unionByName(links)
    found = written(connected_components(joins, "i", "j"), "components")
    ends = found.withColumnsRenamed({"id": "i", "component": "ci"}), found.withColumnsRenamed({"id": "j", "component": "cj"})
    # a ruling "different" matters only where both ends can meet
    placed = edges.join(ends[0], "i").join(ends[1], "j").where("ci = cj").drop("cj")
    tokens = field_tokens(col("employer"), EMPLOYER_WORDS)
    members = rows.join(blocks, "last").join(once, ["source", "norm"]).join(ends[0].withColumnRenamed("i", "ord"), "ord").withColumn("has", F.coalesce("employer", F.lit("")) != "")
    held = shaped(members.withColumn("c", col("ci")), F.lit(NAMES), s1=col("block"), s2=col("ord"), i=col("ord"), source=col("source"), name=col("norm"), tokens=tokens, has=col("has"), once=col("once"), j=col("ci")).withColumn("ci", col("j"))
    of_names = near.join(first.withColumnRenamed("norm", "na"), "na").join(ends[0].withColumnRenamed("i", "first"), "first")
    matched = shaped(of_names, F.lit(MATCH), name=col("na"), other=col("nb"), score=col("score"), n=col("n"), j=col("ci")).withColumn("ci", col("j"))

    whole = placed.unionByName(held).unionByName(matched).select("ci", *Step._fields)
    whole = whole.repartition("ci").sortWithinPartitions("ci", "phase", col("verdict") == "different", "s1", "s2", "s3")
    out = whole.mapInArrow(decided, "kind string, i long, j long, s1 long, s2 long, s3 long, phase int, score double, exact boolean, type string, value string")
    out = written(out, "decided")
    in_groups = out.where("kind = 'group'").select(F.col("i").alias("ord"), F.col("j").alias("member"))
    first = in_groups.groupBy("member").agg(F.min("ord").alias("root"))
    groups = records.select("ord").join(in_groups.join(first, "member").select("ord", "root"), "ord", "left").select("ord", F.coalesce("root", "ord").alias("root"))
    who = records.select("ord", "key", "name", F.coalesce("employer", F.lit("")).alias("employer"))
    a, b = who.select(*(F.col(c).alias(f"{c}_a") for c in who.columns)), who.select(*(F.col(c).alias(f"{c}_b") for c in who.columns))
    pairs = out.where("kind <> 'group'").join(a, F.col("i") == F.col("ord_a")).join(b, F.col("j") == F.col("ord_b"))
    reason = F.when(F.col("phase") == DEFERRED, F.concat(F.lit("shared-"), "type")).when(F.col("exact"), "exact-name").otherwise("fuzzy")
    candidates = pairs.where("kind = 'candidate'").select(
        F.struct("phase", "s1", "s2", "s3").alias("seq"), F.array("key_a", "key_b").alias("keys"), F.array("name_a", "name_b").alias("names"), F.array("employer_a", "employer_b").alias("employers"),
        F.replace(F.format_number("score", 2), F.lit(","), F.lit("")).cast("double").alias("score"), reason.alias("reason"), F.when(F.col("phase") == DEFERRED, F.concat("type", F.lit(":"), "value")).alias("identifier"),
    )
    told = star.where("kind = 'warn'").join(who.select(F.col("ord").alias("holder"), F.col("key").alias("ka")), "holder").join(who.select("ord", "key"), "ord")
    warnings = (
        told.select(F.lit("names differ").alias("kind"), F.col("ka").alias("key_a"), F.col("key").alias("key_b"), F.col("type").alias("detail"))
        .unionByName(unknown.select(F.lit("unknown key in ruling").alias("kind"), "key_a", "key_b", F.col("pos").cast("string").alias("detail")))
        .unionByName(pairs.where("kind = 'conflict'").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "s1"))).select(F.lit("ruling conflicts with a merge").alias("kind"), "key_a", "key_b", F.lit("different").alias("detail")))
    )
    return groups, candidates, warnings


def name_counts(records: DataFrame) -> DataFrame:
    """``records`` with ``same_name``: how many of its source have its normalized name."""
    norm = normalize_name(F.col("name"))
    return records.withColumn("same_name", F.count("*").over(W.partitionBy("source", norm)))
