"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. A trigram's vector binds its three
letters' vectors, each rotated by its place, by multiplication; a text's
vector bundles its trigrams' vectors by addition, and a language's prototype
bundles those of its training texts. A text takes the language whose
prototype has the largest cosine with it.

The dot product of a text and a prototype is evaluated as the sum over the
text's distinct trigrams of count times the trigram's dot product with the
prototype, which is the same number without making the text's vector. The
text's length uses that vectors of different trigrams are close to
orthogonal; it divides every language's product alike, so it has no part in
the choice.

Trigrams run over lower-cased letters, a run of anything else being one
boundary sign, and have a letter in the middle. Each language has one vector
of ``DIM`` doubles, so what goes to the driver and to the executors is 16 KB
a language, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from kinfold.llm._frames import adding, columns, packed
from kinfold.llm._words import U, mix, pieces
from kinfold.session import written

DIM = 2048
UNKNOWN = "und"
#: Trigrams from which a text must be like some language to be accepted, and the score that says so.
ENOUGH, ALIKE = 300, 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 and low.isalpha() else c
    return out


def _signs(letters: np.ndarray, place: int) -> np.ndarray:
    """The letters' vectors of +1 and -1, rotated by ``place``."""
    with np.errstate(over="ignore"):
        word = np.arange(DIM // 64, dtype=U)[None, :] + letters.astype(U)[:, None] * U(0x100000001B3)
    bits = np.unpackbits(mix(mix(word)).view(np.uint8).reshape(len(letters), -1), axis=1)
    return np.roll(bits.astype(np.int8) * 2 - 1, place, axis=1)


def _vectors(keys: np.ndarray) -> np.ndarray:
    """The vectors of trigrams that :func:`_trigrams` names."""
    out = None
    for place in range(3):
        letters, which = np.unique(keys >> (21 * (2 - place)) & 0x1FFFFF, return_inverse=True)
        v = _signs(letters, 2 - place)[which]
        out = v if out is None else out * v
    return out


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text index, trigram, count)`` of each distinct trigram of each text, in that order."""
    parts = [t or "" for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    owner = np.append(0, np.repeat(np.arange(len(parts)), sizes + 1))
    keep = np.append(True, (letter[1:] != 0) | (letter[:-1] != 0))
    letter, owner = letter[keep], owner[keep]
    flag = np.zeros(0x110000, bool)
    flag[letter] = True
    used = np.flatnonzero(flag)
    place = np.zeros(0x110000, np.int64)
    place[used] = np.arange(len(used))
    code, n = place[letter], len(used)
    mid = np.flatnonzero(letter[1:-1]) + 1
    text = owner[mid]
    dense = np.sort(((text * n + code[mid - 1]) * n + code[mid]) * n + code[mid + 1])
    if not len(dense):
        return dense, dense, dense
    start = np.flatnonzero(np.append(True, dense[1:] != dense[:-1]))
    count = np.diff(np.append(start, len(dense)))
    dense = dense[start]
    c, dense = dense % n, dense // n
    b, dense = dense % n, dense // n
    a, text = dense % n, dense // n
    return text, used[a] << 42 | used[b] << 21 | used[c], count


def profiles(docs: DataFrame) -> DataFrame:
    """``(lang, place, value)``: the bundled vector of each language over ``docs(lang, text)``.

    Null texts and languages, and texts without a letter, add nothing. Tasks
    bundle what they read before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                langs = np.array(piece.column("lang").to_pylist(), object)
                text, key, count = _trigrams(piece.column("text"))
                for lang in set(langs):
                    own = np.isin(text, np.flatnonzero(langs == lang))
                    keys, which = np.unique(key[own], return_inverse=True)
                    weight = np.bincount(which, count[own], len(keys))
                    for i in range(0, len(keys), 4096):
                        add = weight[i : i + 4096] @ _vectors(keys[i : i + 4096]).astype(np.float64)
                        total[lang] = total.get(lang, 0) + add
        for lang, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIM, "place": np.arange(DIM, dtype=np.int32), "value": v})

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, place int, value double")
    return rows.groupBy("lang", "place").agg(F.sum("value").alias("value"))


def identify(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_trigrams``.

    ``score``: the dot product with that language's prototype over the lengths
    of both, from 0 to 1. The text's length is that of orthogonal trigram
    vectors, which is the bundled vector's up to a few hundredths; ``score`` is
    the cosine as nearly. Reads only ``text``. A null text, an empty one, one without a letter, and
    any text when there is no profile, get ``und`` and 0; without a letter there
    are no trigrams. Ties go to the first
    language by code point. Repeated rows are treated alike; other columns
    stay, but for those named like the three that are added.
    """
    rows = profile.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in rows]
    matrix = np.array([[x["value"] for x in r["v"]] for r in rows]).reshape(len(langs), DIM)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((matrix / np.where(length > 0, length, 1)).astype(np.float32))
    known: dict[str, np.ndarray] = {"key": np.zeros(0, np.int64), "dot": np.zeros((0, len(langs)), np.float32)}

    def dots(keys: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(keys, return_inverse=True)
        new = distinct[~np.isin(distinct, known["key"], assume_unique=True)]
        if len(known["key"]) > 1 << 21:  # only a cache
            known.update(key=np.zeros(0, np.int64), dot=np.zeros((0, len(langs)), np.float32))
            new = distinct
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            key = np.concatenate([known["key"], part])
            dot = np.concatenate([known["dot"], _vectors(part).astype(np.float32) @ shared.value.T])
            order = np.argsort(key)
            known.update(key=key[order], dot=dot[order])
        return known["dot"][np.searchsorted(known["key"], distinct)][which]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        names: list[str] = []
        scores: list[float] = []
        sizes: list[int] = []
        for piece in pieces(batch):
            n = piece.num_rows
            text, key, count = _trigrams(piece.column("text"))
            seen = np.bincount(text, minlength=n) > 0
            sizes += np.bincount(text, count, n).astype(np.int64).tolist()
            if not langs or not len(text):
                names += [UNKNOWN] * n
                scores += [0.0] * n
                continue
            dot = dots(key)
            by = np.stack([np.bincount(text, count * dot[:, j], n) for j in range(len(langs))], axis=1)
            size = np.sqrt(DIM * np.bincount(text, count.astype(float) ** 2, n))
            best = by.argmax(axis=1)
            cosine = np.clip(by[np.arange(n), best] / np.where(seen, size, 1), 0, 1)
            names += [langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)]
            scores += np.where(seen, cosine, 0.0).tolist()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]

    return adding(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_trigrams", LongType())], make)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3. A null id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> DataFrame:
    """Profiles from the documents that are not held out and have an id and a language."""
    return profiles(docs.where("doc_id is not null").where(~held_out()))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages, with the columns of ``docs``.

    Rejected are texts without a letter, null and empty ones too, and texts of
    at least ``ENOUGH`` trigrams whose score is below ``ALIKE``: they have
    letters, but not in the proportions of any language. A shorter text has too
    little of any profile to tell, so it stays. Repeated rows are treated
    alike; ids may be null; an empty table gives no rows. Without any language
    to learn from only texts without a letter go.
    """
    rows = packed(docs, *(F.col(c).alias(c) for c in ("doc_id", "lang")), F.col("text").cast("string").alias("text"))
    profile = written(learn(rows.select("doc_id", "lang", "text")), "profile")
    found = identify(rows, profile)
    strange = (F.col("n_trigrams") >= ENOUGH) & (F.col("score") < ALIKE)
    if profile.limit(1).count():
        found = found.where(~strange)
    return found.where("n_trigrams > 0").select(*columns(docs))


def predictions(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, n_trigrams)`` of every row, as :func:`identify` and :func:`held_out` treat it.

    A null id is learned from by nobody; an empty table gives no rows.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_trigrams")
