"""Vectorised work on whole texts inside Arrow batches.

Words are runs of bytes outside space and tab to carriage return, as in the
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit and the same in every
process. A batch is walked in pieces of a few megabytes of text, so memory
follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
U = np.uint64

_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: whether it separates words, its value in a hash, and its value once A-Z are lowered."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    with np.errstate(over="ignore"):
        value = mix(np.arange(1, 257, dtype=U) * _ODD) | U(1)
    lower = value.copy()
    lower[65:91] = value[97:123]
    return space, value, lower


@lru_cache(1)
def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_ODD)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, U))
        down = np.cumprod(np.full(n, inverse, U))
    return up, down


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers_of(max(PIECE + (PIECE >> 1), 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each, a longer text alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    yield batch.slice(start)


class Words:
    """The words of some texts: their hashes, byte spans and, by text, their counts.

    ``hash``: one value a word. ``begin``, ``end``: byte offsets in ``data``.
    ``first``: for each text, the index of its first word, with the total at
    the end. Null texts count as empty.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        parts = [t.encode() if t else b"" for t in texts.to_pylist()]
        self.data = b"\n".join(parts) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)])
        space, value, low = _tables()
        gap = space[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.begin, self.end = edge[0::2], edge[1::2]  # the last byte is a separator
        with np.errstate(over="ignore"):
            up, down = _powers(len(buf))
            sums = np.concatenate([np.zeros(1, U), np.cumsum((low if lower else value)[buf] * up)])
            # the power of the first byte is divided out, so a word hashes alike wherever it stands
            self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(U))
        self.first = np.searchsorted(self.begin, self.offset)

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * U(0x2545F4914F6CDD1D | 1) + hashes[i : i + n]
    return mix(out + U(k))


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    runs = runs_of(words.hash, k)
    out = []
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(runs_of(words.hash[a:b], b - a) if b > a else runs[:0])
    return out


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def groups(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of the stretches in which all of some equally long arrays stay the same."""
    n = len(keys[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new).tolist()
    return list(zip(start, [*start[1:], n], strict=True))


#: Bits of a filter, at most: 32 MB, which let about one in a hundred others through beside 27 million keys, and more beyond.
MOST_BITS = 1 << 28


def filter_bits(keys: int, least: int) -> int:
    """The bits of a filter for so many keys: a power of two with ten for each, at least ``least``, at most ``MOST_BITS``."""
    return min(MOST_BITS, max(least, 1 << (10 * keys).bit_length()))
