"""Substring dedup by sliding sentence spans.

A sentence ends at a word that closes with ``.``, ``!`` or ``?``, at a line
break, or with the text. From every sentence on, the shortest run of sentences
of at least ``WORDS`` words together is a span (one long sentence can be one),
and so is the shortest such run up to every sentence; a text of fewer words is
one as a whole. Any repeated run of at least ``WORDS`` words is covered by the
spans inside it, to its last sentence, so longer runs need no hashes. A span's
hash is taken over lower-cased words. A span that occurs several times is
kept where it is first, by document id and place; every sentence that another
occurrence covers is removed.

1. Tasks hash all spans and pass on one row for each distinct hash, with its
   first place; by bucket of hashes the global first place of repeated ones is
   found.
2. The most frequent repeated spans are broadcast, ``FREQUENT`` of them at any
   corpus size, so that no bucket meets all copies of a passage that a large
   part of the documents holds. Other occurrences, if a filter of fixed size
   holds their hash, go to the bucket of their hash and learn whether they are
   first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from kinfold.llm._frames import adding, columns, packed
from kinfold.llm._words import U, Words, _powers, blob, filter_bits, groups, mix, pieces
from kinfold.session import written

#: Words of a span at least.
WORDS = 25
#: Repeated spans, most frequent first, that are broadcast (24 bytes each).
FREQUENT = 1 << 16
#: Bits of the filter of repeated hashes.
FILTER_BITS = 1 << 25
#: Spans gathered in a task before they are passed on, and of a bucket on average.
GATHER = 2_000_000
LAST = np.iinfo(np.int64).max


class Spans:
    """The spans of some texts: ``hash``, ``text``, and ``first`` and ``last`` sentence within the text.

    ``begin`` and ``end``: words of each sentence; ``sentences``: for each text
    the index of its first sentence, with the total at the end. Without
    ``ends`` only the runs from every sentence on are spans.
    """

    def __init__(self, texts: pa.Array, ends: bool = True):
        w = self.words = Words(texts)
        n = len(w)
        buf = np.frombuffer(w.data, np.uint8)
        breaks = np.concatenate([[0], np.cumsum((buf == 10) | (buf == 13))])
        after = np.append(w.begin[1:], len(buf)) if n else w.begin
        close = np.isin(buf[w.end - 1], np.frombuffer(b".!?", np.uint8)) | (breaks[after] > breaks[w.end])
        close[w.first[1:][np.diff(w.first) > 0] - 1] = True
        self.end = np.flatnonzero(close) + 1
        self.begin = np.concatenate([[0], self.end[:-1]]) if len(self.end) else self.end
        self.sentences = np.searchsorted(self.begin, w.first)
        text = np.searchsorted(self.sentences, np.arange(len(self.begin)), side="right") - 1
        last = np.searchsorted(self.end, self.begin + WORDS)
        ok = np.flatnonzero(last < self.sentences[text + 1])
        if ends:
            # the latest start of a long enough run up to each sentence, where the run from that start on ends earlier
            start = np.searchsorted(self.begin, self.end - WORDS, side="right") - 1
            to = np.flatnonzero(start >= self.sentences[text])
            to = to[last[start[to]] < to]
            size = w.counts()
            short = np.flatnonzero((size > 0) & (size < WORDS))
            ok, last = np.concatenate([ok, start[to], self.sentences[short]]), np.concatenate([last[ok], to, self.sentences[short + 1] - 1])
            order = np.lexsort((last, ok))
            ok, last = ok[order], last[order]
        else:
            last = last[ok]
        self.text = text[ok]
        a, b = self.begin[ok], self.end[last] if len(ok) else self.begin[ok]
        up, down = _powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash) * up[:n])])
            self.hash = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U)) if len(ok) else np.zeros(0, U)
        self.first, self.last = ok - self.sentences[self.text], last - self.sentences[self.text]

    def points(self, text: int, sentence: int) -> tuple[int, int]:
        """Where a sentence begins and ends in its text, in code points."""
        k = self.sentences[text] + sentence
        a, lo = int(self.words.offset[text]), self.words.begin[self.begin[k]]
        hi = self.words.end[self.end[k] - 1]
        head = len(self.words.data[a:lo].decode())
        return head, head + len(self.words.data[lo:hi].decode())


def _text_keys(w: Words) -> np.ndarray:
    """A hash of each text's words, which tells rows of one id apart."""
    up, down = _powers(len(w) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * up[: len(w)])])
        return mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]]).view(np.int64)


def _id(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids, null as the last of all."""
    return np.asarray(batch.column("doc_id").fill_null(LAST), np.int64)


def _firsts(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray):
    """One entry for each hash: its first place by document and sentence, and how often it is there."""
    order = np.lexsort((at, doc, hashes))
    hashes, doc, at, count = hashes[order], doc[order], at[order], count[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[start], doc[start], at[start], np.add.reduceat(count, start) if len(start) else count


def _rows(names: list[str], bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names)])
    for a, b in groups(bucket):
        yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[a])], **{n: [blob(x[a:b])] for n, x in zip(names, arrays, strict=True)}}, schema)


def _read(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _repeated(docs: DataFrame, buckets: int, ends: bool) -> DataFrame:
    """``(bucket, hash, doc, at, count)``: repeated hashes with their first places, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        def out() -> Iterator[pa.RecordBatch]:
            h, d, a, c = _firsts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return _rows(["hash", "doc", "at", "count"], (h % U(buckets)).astype(np.int64), [h, d, a.astype(np.int32), c.astype(np.int32)])
        for batch in batches:
            for piece in pieces(batch):
                s = Spans(piece.column("text"), ends)
                parts.append((s.hash, _id(piece)[s.text], s.first, np.ones(len(s.hash), np.int64)))
                held += len(s.hash)
                if held > GATHER:
                    yield from out()
                    held, parts = 0, []
        if parts:
            yield from out()

    def reduce(table: pa.Table) -> pa.Table:
        h, d, a, c = _firsts(_read(table, "hash", U), _read(table, "doc"), _read(table, "at", np.int32).astype(np.int64), _read(table, "count", np.int32).astype(np.int64))
        keep = c > 1
        got = {"hash": [blob(h[keep])], "doc": [blob(d[keep])], "at": [blob(a[keep].astype(np.int32))], "count": [blob(c[keep])]}
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in got.items()}})

    schema = "bucket int, hash binary, doc binary, at binary, count binary"
    return docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(reduce, schema)


def _frequent(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent hashes, ``FREQUENT`` of them at most, in order of hash, with their first places.

    How many hashes have each size of count is known first, so only those that
    are wanted come to the driver. If more than that share the largest count,
    none is frequent: each is then less than one in ``FREQUENT`` of all places.
    """
    size = lambda t: np.floor(8 * np.log2(_read(t, "count"))).astype(np.int32)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, n = np.unique(size(pa.Table.from_batches([batch])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n.astype(np.int64))], names=["level", "n"])

    levels = repeated.mapInArrow(sizes, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["level"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            top = size(t) >= least
            h, d, a = _read(t, "hash", U), _read(t, "doc"), _read(t, "at", np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(d[top]), pa.array(a[top])], names=["hash", "doc", "at"])

    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = repeated.mapInArrow(best, "hash long, doc long, at int").toPandas()
    h = rows["hash"].to_numpy(np.int64).view(U)
    order = np.argsort(h)
    return h[order], rows["doc"].to_numpy(np.int64)[order], rows["at"].to_numpy(np.int64)[order]


def _filter(repeated: DataFrame) -> np.ndarray:
    """Bits that hold every repeated hash."""
    keys = repeated.agg(F.coalesce(F.sum(F.octet_length("hash")), F.lit(0))).first()[0] // 8
    size = filter_bits(keys, FILTER_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_places(_read(pa.Table.from_batches([batch]), "hash", U), size)] = True
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(blob(np.packbits(bits)), 1)]})

    bits = np.zeros(size // 8, np.uint8)
    for row in repeated.select("hash").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return bits


def _places(h: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([h & U(size - 1), h >> U(65 - size.bit_length())]).astype(np.int64)


def removals(docs: DataFrame, ends: bool = True) -> DataFrame:
    """``(doc_id, text_key, n_sentences, n_removed, removed)`` of every row of ``docs(doc_id, text)``.

    ``removed``: begins and ends of what goes, in code points, as
    ``begin:end`` joined by commas, neighbouring sentences as one.
    Null and empty texts have no sentences. Without ``ends``, spans are only the
    runs from every sentence on: the end of a repeated run can stay, and texts of
    fewer than ``WORDS`` words do. Rows with one id count as one document where the
    first place is sought, so equal rows are treated alike. A null id comes
    after all others. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.select(F.octet_length("text").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (20 * GATHER) + 1)
    repeated = written(_repeated(docs, buckets, ends), "repeated")
    shared = spark.sparkContext.broadcast((*_frequent(repeated), _filter(repeated)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_doc, top_at, bits = shared.value
        schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_sentences", pa.int64()), ("marks", pa.binary()), *((n, pa.binary()) for n in ("hash", "doc", "key", "at", "last"))])
        for batch in batches:
            for piece in pieces(batch):
                s = Spans(piece.column("text"), ends)
                n, ids, w = piece.num_rows, _id(piece), s.words
                key = _text_keys(w)
                at = np.minimum(np.searchsorted(top, s.hash), max(len(top) - 1, 0))
                hot = top[at] == s.hash if len(top) else np.zeros(len(s.hash), bool)
                first = hot & (top_doc[at] == ids[s.text]) & (top_at[at] == s.first) if len(top) else hot
                mark = np.flatnonzero(hot & ~first)
                p = _places(s.hash, len(bits) * 8)
                ask = np.flatnonzero((bits[p >> 3] >> (7 - (p & 7)) & 1).reshape(2, -1).all(axis=0) & ~hot)
                cut = np.searchsorted(s.text[mark], np.arange(n + 1))
                pairs = np.stack([s.first[mark], s.last[mark]], axis=1).astype(np.int32)
                marks = [blob(pairs[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), piece.column("doc_id"), pa.array(key), pa.array(np.diff(s.sentences)), pa.array(marks, pa.binary()), *[none] * 5], schema=schema)
                asked = [s.hash[ask], ids[s.text[ask]], key[s.text[ask]], s.first[ask].astype(np.int32), s.last[ask].astype(np.int32)]
                for r in _rows(["hash", "doc", "key", "at", "last"], (s.hash[ask] % U(buckets)).astype(np.int64), asked):
                    yield pa.RecordBatch.from_arrays([r.column(0), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *r.columns[1:]], schema=schema)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, doc, key, at, last = _read(asked, "hash", U), _read(asked, "doc"), _read(asked, "key"), _read(asked, "at", np.int32), _read(asked, "last", np.int32)
        k, kd, ka = _read(known, "hash", U), _read(known, "doc"), _read(known, "at", np.int32)
        p = np.minimum(np.searchsorted(k, h), max(len(k) - 1, 0))
        mark = (k[p] == h) & ~((kd[p] == doc) & (ka[p] == at)) if len(k) else np.zeros(len(h), bool)
        doc, key, at, last = doc[mark], key[mark], at[mark], last[mark]
        order = np.lexsort((at, key, doc))
        doc, key, pairs = doc[order], key[order], np.stack([at, last], axis=1)[order]
        each = groups(doc, key)
        start = np.array([a for a, _ in each], np.int64)
        marks = [blob(pairs[a:b]) for a, b in each]
        return pa.table({"doc": doc[start], "text_key": key[start], "more": pa.array(marks, pa.binary())})

    schema = "bucket int, doc_id long, text_key long, n_sentences long, marks binary, hash binary, doc binary, key binary, at binary, last binary"
    asked = written(docs.mapInArrow(run, schema), "asked")
    told = asked.where("bucket is not null").groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(answer, "doc long, text_key long, more binary")
    # identical rows of the table get their answers several times over
    told = told.groupBy("doc", "text_key").agg(F.collect_set("more").alias("more"))
    base = asked.where("bucket is null").select("doc_id", "text_key", "n_sentences", "marks")
    joined = base.join(told.withColumnRenamed("text_key", "k"), (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("doc")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select("doc_id", "text_key", "n_sentences", F.when(F.col("more").isNull() & (F.length("marks") == 0), F.lit(None)).otherwise(F.concat(F.array("marks"), F.coalesce("more", F.array()))).alias("marks"))


def _covered(n: int, marks: list[bytes] | None) -> np.ndarray:
    """Which of ``n`` sentences go."""
    step = np.zeros(n + 1, np.int64)
    for m in marks or ():
        pairs = np.frombuffer(m, np.int32).reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1] + 1, -1)
    return np.cumsum(step[:-1]) > 0


def report(docs: DataFrame, ends: bool = False) -> DataFrame:
    """``(doc_id, n_sentences, n_removed, removed)`` of every row; ``removed`` lists sentence ranges ``first-last``.

    The query and ``clean`` have ``ends``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, told = [], []
            for n, marks in zip(batch.column("n_sentences").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                gone = _covered(n, marks)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                count.append(int(gone.sum()))
                told.append(",".join(f"{a}-{b - 1}" for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_sentences"), pa.array(count, pa.int64()), pa.array(told, pa.string())], names=["doc_id", "n_sentences", "n_removed", "removed"])

    return removals(docs, ends).mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed string")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated sentences cut from ``text``; every row and the other columns stay.

    A line break or space that only parted removed sentences goes with them.
    """
    def keys(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for piece in pieces(batch):
            w = Words(piece.column("text"))
            out.append(_text_keys(w))
        return [pa.array(np.concatenate(out))]

    rows = packed(docs, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"))
    keyed = adding(rows, [StructField("text_key", LongType())], keys)
    found = removals(docs).where("marks is not null").dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    joined = keyed.join(found, keyed["id"].eqNullSafe(found["i"]) & (keyed["text_key"] == found["k"]), "left")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for piece in pieces(batch):
            s, texts = Spans(piece.column("text")), piece.column("text").to_pylist()
            for t, (text, marks) in enumerate(zip(texts, piece.column("marks").to_pylist(), strict=True)):
                if not marks:
                    out.append(text)
                    continue
                n = int(s.sentences[t + 1] - s.sentences[t])
                gone, kept, start = _covered(n, marks), [], 0
                for k in np.flatnonzero(gone).tolist():
                    a, _ = s.points(t, k)
                    b = s.points(t, k + 1)[0] if k + 1 < n else len(text)
                    kept.append(text[start:a])
                    start = b
                out.append("".join(kept) + text[start:])
        return [pa.array(out, pa.string())]

    done = adding(joined.select("row", "text", "marks"), [StructField("cut", StringType())], cut)
    return done.select(*columns(docs, text=F.col("cut")))
