"""Personal data: base patterns, and terms that give protected entities away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern,
and codes: long terms of letters and digits mixed, as keys and access tokens
are. Each distinct value is a protected entity, and so is each kind, the fact
that one stands here. A code is the entity itself, so as a term it leaves no
bits and is taken out. Other terms near an entity are judged by what they tell
about it: over the corpus, a term's disclosure of an entity is the information
left to guess it, ``-log2 P(entity | term)``, where P is the share of the term's
documents that have the term near the entity. A term that leaves at most
``GENERALISE`` bits about a value is replaced by a placeholder, one that leaves
at most ``REMOVE`` bits is taken out, wherever it stands. There are few kinds, so
what tells a kind must leave at most ``REMOVE`` bits, and is replaced.

One meeting proves nothing: a term needs ``CONTEXTS`` different surroundings of
the same entity, and copies of a document have the same surroundings. What
announces a kind is in one of a hundred of the kind's surroundings at least.

1. One pass finds the base spans and hashes entities, nearby terms and their
   surroundings.
2. Pairs with enough surroundings name candidate terms; a second pass, with the
   candidates in a filter of bounded size, counts the documents of each.
3. A third pass marks the terms beyond the threshold, joined by hash.

Passes 2 and 3 are left out when no pair has enough surroundings.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from kinfold.llm._frames import adding, columns, packed
from kinfold.llm._words import U, Words, blob, filter_bits, mix, pieces
from kinfold.session import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Terms on each side of an entity that count as near it.
WINDOW = 5
CONTEXTS = 3
#: Share of a kind's surroundings that a term must be in to announce it: so a kind has at most ``2 * WINDOW / KIND_SHARE`` candidates.
KIND_SHARE = 0.01
#: Bytes of a term, at least: shorter ones are particles and numbers that stand everywhere.
LEAST_BYTES = 3
#: Characters of a code, at least; longer than words with a digit in them are.
CODE_LENGTH = 16
CODE_KIND = 5
GENERALISE, REMOVE = 1.0, 0.25
#: Bits of the filter for terms, at least.
FILTER_BITS = 1 << 24

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# a match never begins inside a run of digits whose first digit failed
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]+")
CODE = re.compile(rf"(?<![^\W_])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{{{CODE_LENGTH},}}+(?![^\W_])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: the run of name signs before an at sign that a domain follows."""
    at, free = text.find("@"), 0
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in order; matches that fail their test are dropped without another try."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m[0])) if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Terms(Words):
    """Words of letters and digits only; ASCII signs part them like space."""

    GAPS = bytes(c if chr(c).isalnum() or c >= 128 or c in (10,) else 32 for c in range(256))

    def __init__(self, texts: list[str]):
        clean = [t.encode().translate(self.GAPS).replace(b"\n", b" ") for t in texts]
        super().__init__(pa.array([c.decode() for c in clean]))


def codes(text: str) -> list[tuple[int, int]]:
    """Where codes stand: whole terms of at least ``CODE_LENGTH`` ASCII letters and digits, some of each."""
    return [m.span() for m in CODE.finditer(text)]


def _side(flat: str, at: int, step: int) -> str:
    """The text on one side of a place, as far as ``WINDOW`` whole terms reach."""
    size = 32 * WINDOW
    while True:
        piece = flat[max(0, at - size) : at] if step < 0 else flat[at : at + size]
        if len(piece) < size or len(TERM.findall(piece)) > WINDOW:
            return piece
        size *= 4


def _near(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[int], str, str]]:
    """For each span the hashes of its value and of its kind, and the text on either side, without other entities."""
    parts, at = [], 0
    for a, _, b in spans:
        if b > at:
            parts += [text[at:a], " " * (b - max(a, at))]
            at = b
    flat = "".join([*parts, text[at:]])
    out = []
    for a, k, b in spans:
        value = text[a:b].lower() if k in (0, CODE_KIND) else "".join(DIGIT.findall(text[a:b])) if k > 1 else text[a:b]
        out.append(([_key_of(f"{k}:{value}"), _kind_of(k)], _side(flat, a, -1), _side(flat, b, 1)))
    return out


def _kind_of(k: int) -> int:
    return _key_of(f"kind:{k}")


def _key_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _found(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, spans, codes, near)``: base spans, codes, and for each entity's place the terms around it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.int64()))]))
        code_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans_out, codes_out, near_out, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                keys.append(_key_of(text))
                spans, own = base_spans(text), codes(text)
                spans_out.append(told(spans))
                codes_out.append([{"start": a, "end": b} for a, b in own])
                near = []
                if spans or own:
                    around = _near(text, sorted(spans + [(a, CODE_KIND, b) for a, b in own]))
                    w = Terms([x for _, a, b in around for x in (a, b)])
                    for i, (entities, _, _) in enumerate(around):
                        a, b, c = w.first[2 * i : 2 * i + 3]
                        own = np.concatenate([w.hash[max(a, b - WINDOW) : b], w.hash[b : min(c, b + WINDOW)]])
                        size = np.concatenate([(w.end - w.begin)[max(a, b - WINDOW) : b], (w.end - w.begin)[b : min(c, b + WINDOW)]])
                        context = int(mix(own).sum(dtype=U).view(np.int64)) if len(own) else 0
                        terms = np.unique(own[size >= LEAST_BYTES].view(np.int64)).tolist()
                        near += [{"entity": e, "context": context, "terms": terms} for e in entities]
                near_out.append(near)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(spans_out, pa.string()), pa.array(codes_out, code_type), pa.array(near_out, near_type)], names=["doc_id", "text_key", "spans", "codes", "near"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, spans string, codes array<struct<start:int,end:int>>, near array<struct<entity:long,context:long,terms:array<long>>>")


def _places(h: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([h & U(size - 1), h >> U(24) & U(size - 1)]).astype(np.int64)


def _filter(terms: DataFrame):
    """A broadcast of bits that hold every ``term``."""
    size = filter_bits(terms.count(), FILTER_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy().view(U), size)] = True
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(blob(np.packbits(bits)), 1)]})

    bits = np.zeros(size // 8, np.uint8)
    for row in terms.select("term").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return terms.sparkSession.sparkContext.broadcast(bits)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = _places(h, len(bits) * 8)
    return (bits[p >> 3] >> (7 - (p & 7)) & 1).reshape(2, -1).all(axis=0)


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, docs)``: the documents of each term that the filter lets through."""
    shared = _filter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = Terms([t or "" for t in piece.column("text").to_pylist()])
                at = np.flatnonzero(_held(shared.value, w.hash))
                text = np.searchsorted(w.first, at, side="right") - 1
                pair = np.unique(np.stack([text.astype(np.int64), w.hash[at].view(np.int64)]), axis=1)
                term, n = np.unique(pair[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "docs"])

    return docs.mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(text_key, marks)``: where the texts have ``terms(term, action)``."""
    shared = _filter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                w = Terms(texts)
                at = np.flatnonzero(_held(shared.value, w.hash))
                text = np.searchsorted(w.first, at, side="right") - 1
                keys, start, end = [], [], []
                for i, t in zip(at.tolist(), text.tolist(), strict=True):
                    base = int(w.offset[t])
                    a = len(w.data[base : w.begin[i]].decode())
                    keys.append(_key_of(texts[t]))
                    start.append(a)
                    end.append(a + len(w.data[w.begin[i] : w.end[i]].decode()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(w.hash[at].view(np.int64)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["text_key", "term", "start", "end"])

    rows = docs.mapInArrow(run, "text_key long, term long, start int, end int").join(terms, "term")
    return rows.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("marks"))


def findings(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, spans, marks)`` of every row: base spans as text, and disclosing terms and codes with what to do.

    Null texts count as empty. Equal rows count each, both where a term meets
    an entity and where it stands, and are treated alike. Ties between entities
    go to the one that a term gives away most. An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = written(_found(rows), "found")
    near = found.where(F.size("near") > 0).select(F.monotonically_increasing_id().alias("row"), F.explode("near").alias("x"))
    each = near.select("row", "x.entity", "x.context", F.explode("x.terms").alias("term"))
    contexts = each.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    pairs = each.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("met"))
    of_kind = F.col("entity").isin(*map(_kind_of, range(len(KINDS) + 1)))
    places = each.where(of_kind).select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("places"))  # a row a kind
    enough = contexts.join(F.broadcast(places), "entity", "left").where(F.col("contexts") >= F.greatest(F.lit(CONTEXTS), KIND_SHARE * F.coalesce("places", F.lit(0))))
    candidates = written(enough.join(pairs, ["entity", "term"]), "candidates")
    own = F.transform("codes", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("remove").alias("action")))
    marks = None
    if candidates.limit(1).count():
        df = _frequencies(rows, candidates.select("term").distinct())
        left = -F.log2(F.least(F.lit(1.0), F.col("met") / F.col("docs")))
        bits = lambda which: F.coalesce(F.min(F.when(which, left)), F.lit(float("inf")))
        terms = candidates.join(df, "term").groupBy("term").agg(bits(~of_kind).alias("value"), bits(of_kind).alias("kind")).where((F.col("value") <= GENERALISE) | (F.col("kind") <= REMOVE))
        terms = written(terms.select("term", F.when(F.col("value") <= REMOVE, "remove").otherwise("generalise").alias("action")), "terms")
        if terms.limit(1).count():
            marks = _marked(rows, terms)
    if marks is None:
        return found.select("doc_id", "text_key", "spans", own.alias("marks"))
    joined = found.join(marks, "text_key", "left")
    # a code that is a disclosing term too is one mark
    more = F.filter(F.coalesce("marks", F.filter(own, lambda x: F.lit(False))), lambda m: ~F.exists("codes", lambda c: c["start"] == m["start"]))
    return joined.select("doc_id", "text_key", "spans", F.array_sort(F.concat(own, more)).alias("marks"))


def _spans(text: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term)`` of every row, as :func:`findings` treats it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, all_spans, terms = batch.column("spans").to_pylist(), [], []
            for text, marks in zip(base, batch.column("marks").to_pylist(), strict=True):
                more = [(m["start"], 4, m["end"]) for m in marks or ()]
                terms.append(len(more))
                all_spans.append(told(sorted(_spans(text) + more)) if more else text)
            count = {f"n_{k}": pa.array([t.count(f"{k}:") for t in base], pa.int64()) for k in KINDS[:4]}
            sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *count.values(), sha, pa.array(all_spans, pa.string()), pa.array(terms, pa.int64())], names=["doc_id", *count, "base_sha256", "spans", "n_term"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return findings(docs).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised: entities and generalised terms as ``<kind>``, removed terms gone.

    Where spans overlap, the one that begins first is applied, then what
    begins after its end. Null texts stay null; other columns stay.
    """
    row = packed(docs, F.col("text").cast("string").alias("text"))
    found = findings(docs).where("spans <> '' or size(marks) > 0").select("text_key", "spans", "marks").dropDuplicates(["text_key"])

    def keys(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text").to_pylist()
        return [pa.array([_key_of(t or "") for t in texts], pa.int64())]

    def apply(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, spans, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "marks")), strict=True):
            todo = [(a, b, f"<{KINDS[k]}>") for a, k, b in _spans(spans or "")]
            todo += [(m["start"], m["end"], "<term>" if m["action"] == "generalise" else "") for m in marks or ()]
            parts, at = [], 0
            for a, b, put in sorted(todo):
                if a >= at:
                    parts += [text[at:a], put]
                    at = b
            out.append(text if text is None else "".join(parts) + text[at:])
        return [pa.array(out, pa.string())]

    keyed = adding(row, [StructField("text_key", LongType())], keys)
    done = adding(keyed.join(found, "text_key", "left"), [StructField("clean", StringType())], apply)
    return done.select(*columns(docs, text=F.col("clean")))
