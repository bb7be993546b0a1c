"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``SEED`` words are
compared: the longest runs of words they share that overlap no run marked
before are marked as tiles, longest first, until none of ``SEED`` words is
left. Common runs are found by running Karp-Rabin: runs of the seed's length
are compared by rolling hash, grow word by word, and are looked for again after
tiles were marked. An item is covered by the share of its words in tiles, in
whatever order the document has them; at ``COVERAGE`` the document counts as
contaminated. An item of fewer words than a seed only counts as a whole text.

An item's runs of ``SEED`` words go into an index. It is broadcast if it stays
below ``INDEX_ROWS`` entries; a larger benchmark is taken in parts of that
size, one pass over the documents each, so no part outgrows a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kinfold.llm._frames import adding, columns, packed
from kinfold.llm._words import U, Words, blob, pieces, runs_of

#: Words of a seed and of the shortest tile; an item of fewer words is its own seed, of whole texts only.
SEED = 5
#: Share of an item's words in tiles from which a document is contaminated.
COVERAGE = 0.6
#: Words of the items that are compared in one pass (8 bytes each).
INDEX_ROWS = 2_000_000


def tiles(doc: np.ndarray, item: np.ndarray, least: int, at: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """``(place in doc, place in item, length)`` of greedy tiles between two sequences of word hashes.

    ``at``: places where runs of ``least`` words agree, if known. Ties: the
    first in the item, then in the document.
    """
    if at is None:
        a, b = runs_of(doc, least), runs_of(item, least)
        where = defaultdict(list)
        for i, h in enumerate(a.tolist()):
            where[h].append(i)
        at = [(i, j) for j, h in enumerate(b.tolist()) for i in where.get(h, ())]
    # seeds that follow each other on a diagonal make one maximal run
    runs, last = [], {}
    for i, j in sorted(at, key=lambda p: (p[1], p[0])):
        k = last.get((i - 1, j - 1))
        if k is None:
            k = len(runs)
            runs.append([i, j, least])
        else:
            runs[k][2] += 1
        last[i, j] = k
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    by_length = defaultdict(list)
    for i, j, n in runs:
        by_length[n].append((j, i))
    out = []
    n = max(by_length, default=0)
    while n >= least:
        for j, i in sorted(by_length.pop(n, ())):
            ok = free_doc[i : i + n] & free_item[j : j + n]
            if ok.all():
                free_doc[i : i + n] = free_item[j : j + n] = False
                out.append((i, j, n))
                continue
            # what is left of the run, in pieces, is looked at again at its own length
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    by_length[b - a].append((j + a, i + a))
        n = max(by_length, default=0)
    return out


class Index:
    """Items' word hashes, and where each seed stands in them."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items
        seeds, of, place = [], [], []
        for k, (_, words) in enumerate(items):
            n = min(SEED, len(words))
            runs = runs_of(words, n) if n else words
            seeds.append(runs)
            of.append(np.full(len(runs), k))
            place.append(np.arange(len(runs)))
        seed = np.concatenate([*seeds, np.zeros(0, U)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.of, self.place = seed[order], np.concatenate([*of, np.zeros(0, np.int64)])[order], np.concatenate([*place, np.zeros(0, np.int64)])[order]
        self.lengths = sorted({min(SEED, len(w)) for _, w in items if len(w)})
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.seed >> U(42)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Places of ``runs`` that are a seed."""
        maybe = np.flatnonzero(self.filter[(runs >> U(42)).astype(np.int64)])
        at = np.searchsorted(self.seed, runs[maybe])
        return maybe[self.seed[np.minimum(at, len(self.seed) - 1)] == runs[maybe]] if len(self.seed) else maybe[:0]

    def best(self, words: Words) -> list[tuple[int, float, int]]:
        """For each text the item with the largest coverage, that, and how many items reach ``COVERAGE``."""
        n = len(words.first) - 1
        pairs: dict[tuple[int, int], list] = defaultdict(list)
        for k in self.lengths:
            runs = runs_of(words.hash, k)
            if not len(runs):
                continue
            at = self.hits(runs)
            text = np.searchsorted(words.first, at, side="right") - 1
            inside = at + k <= words.first[text + 1]
            if k < SEED:  # so short an item counts only as a whole text
                inside &= words.first[text + 1] - words.first[text] == k
            at, text = at[inside], text[inside]
            lo, hi = np.searchsorted(self.seed, runs[at]), np.searchsorted(self.seed, runs[at], side="right")
            for p, t, a, b in zip(at.tolist(), text.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for x in range(a, b):
                    pairs[t, int(self.of[x])].append((p - int(words.first[t]), int(self.place[x])))
        found = [(-1, 0.0, 0)] * n
        for (t, k), at in sorted(pairs.items()):
            item = self.items[k][1]
            least = min(SEED, len(item))
            # the words of the item that any seed touches bound what tiles can cover
            touched = np.zeros(len(item) + 1, np.int64)
            for j in {j for _, j in at}:
                touched[j] += 1
                touched[min(j + least, len(item))] -= 1
            if (np.cumsum(touched[:-1]) > 0).sum() < COVERAGE * len(item) and (np.cumsum(touched[:-1]) > 0).sum() <= found[t][1] * len(item):
                continue
            doc = words.hash[words.first[t] : words.first[t + 1]]
            covered = sum(n for *_, n in tiles(doc, item, least, at)) / len(item)
            best, most, count = found[t]
            if covered > most:
                best, most = k, covered
            found[t] = (best, most, count + (covered >= COVERAGE))
        return found


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The items in parts of at most ``INDEX_ROWS`` words, an item longer than that alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = Words(piece.column("text"))
                hashes = [blob(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("item_id"), pa.array(hashes, pa.binary())], names=["item_id", "words"])

    schema = StructType([StructField("item_id", benchmark.schema["item_id"].dataType)]).add("words", "binary")
    held, part = 0, []
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    for row in rows.mapInArrow(run, schema).toLocalIterator():
        words = np.frombuffer(row["words"], U)
        if part and held + len(words) > INDEX_ROWS:
            yield part
            held, part = 0, []
        part.append((row["item_id"], words))
        held += len(words)
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``item_id``, ``coverage``, ``n_items`` and ``contaminated``.

    ``item_id``: the item with the largest coverage, of equals the first by id;
    null if no seed is shared. Words are compared without the case of A-Z.
    Null and empty texts, and items without words, share nothing; repeated
    items count each. An empty benchmark leaves every document clean. Columns
    of ``docs`` named like the new ones are replaced, others stay.
    """
    kind = benchmark.schema["item_id"].dataType
    fields = [StructField("item_id", kind), *StructType().add("coverage", "double").add("n_items", "long").add("contaminated", "boolean").fields]
    out = docs.drop(*(f.name for f in fields))
    for k, part in enumerate(_parts(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        made: dict[int, Index] = {}

        def make(batch: pa.RecordBatch, shared=shared, made=made, k=k) -> list[pa.Array]:
            if 0 not in made:
                made[0] = Index(shared.value)
            index = made[0]
            found = [x for piece in pieces(batch) for x in index.best(Words(piece.column("text")))]
            ids = [index.items[i][0] if i >= 0 else None for i, *_ in found]
            score, count = [x[1] for x in found], [x[2] for x in found]
            if k:  # what earlier parts found, where it is as good
                old = [batch.column(f.name).to_pylist() for f in fields]
                ids = [o if c >= s else i for i, s, o, c in zip(ids, score, old[0], old[1], strict=True)]
                score = [max(s, c) for s, c in zip(score, old[1], strict=True)]
                count = [c + o for c, o in zip(count, old[2], strict=True)]
            item = pa.array(ids, batch.schema.field("item_id").type) if k else pa.array(ids, _arrow(kind))
            return [item, pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array([c > 0 for c in count], pa.bool_())]

        out = adding(out, fields, make) if not k else _again(out, fields, make)
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _again(df: DataFrame, fields: list[StructField], make) -> DataFrame:
    """``df`` with its last columns, ``fields``, made anew."""
    n = len(df.columns) - len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *make(batch)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, contaminated, item_id, coverage, n_items)`` of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return contaminated(rows, benchmark).select("doc_id", "contaminated", "item_id", "coverage", "n_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns."""
    rows = packed(docs, F.col("text").cast("string").alias("text"))
    return contaminated(rows, benchmark).where("not contaminated").select(*columns(docs))
