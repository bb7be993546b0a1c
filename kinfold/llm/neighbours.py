"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one; its difference from the nearest of a few
centroids is rotated at random and kept as one sign bit a dimension, with its
length and the inner product of the signs and the difference as correction.
From the bits and these scalars the inner product with a query is estimated
without bias, and its error is bounded with high probability by a multiple of
1/sqrt(dimensions) (RaBitQ, Gao and Long, SIGMOD 2024). The best by estimate
are compared exactly, which gives a floor, and then every vector whose upper
bound reaches the floor.

Every vector has a code, made once, and every query meets all of them. Both are
dealt into blocks of at most ``BLOCK_BYTES`` by a hash of the id, and each pair
of blocks is one task with its own best k; only those meet afterwards. Vectors
are copied once for each block of queries, of which there is one up to 1.6
million vectors of 64 dimensions, and queries once for each block of vectors.
The centroids are fitted on at most ``SAMPLE`` vectors; they affect how tight
the bounds are, and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.session import written

#: Vectors that the centroids are fitted on: those with the smallest hash of their id.
SAMPLE = 8192
CENTROIDS = 32
#: Bytes of the vectors of a block, at most, and rows for which a block is worth a task.
BLOCK_BYTES, LEAST_ROWS = 16 << 20, 2048
#: Bits of a query's rotated component, and how many times k vectors are compared for the floor.
QUERY_BITS, FIRST = 4, 8
#: How many standard errors the bounds allow.
EPSILON = 3.0
CHUNK = 64


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows at length one, without overflow for large components."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Centroids of some unit vectors by Lloyd's rounds from spread-out rows."""
    k = min(k, len(sample))
    centroids = sample[:: max(1, len(sample) // k)][:k].copy()
    for _ in range(rounds):
        near = (sample @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        for c in range(k):
            own = sample[near == c]
            if len(own):
                centroids[c] = own.mean(axis=0)
    return centroids


class Codes:
    """One-bit codes of unit vectors: packed signs and their correction scalars."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray):
        self.dim = vectors.shape[1]
        self.cell = (vectors @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        rest = vectors - centroids[self.cell]
        self.length = np.sqrt((rest * rest).sum(axis=1))
        turned = rest @ rotation(self.dim).T
        signs = turned > 0
        self.words = packed_bits(signs)
        self.fit = np.abs(turned).sum(axis=1) / (np.sqrt(self.dim) * np.where(self.length > 0, self.length, 1))
        # what the centroid adds to the product with the signs
        middle = (centroids @ rotation(self.dim).T)[self.cell]
        self.middle = np.where(signs, middle, -middle).sum(axis=1) / np.sqrt(self.dim)

    COLUMNS = ("cell", "length", "fit", "middle")

    @classmethod
    def read(cls, table: pa.Table, dim: int) -> Codes:
        out = cls.__new__(cls)
        out.dim = dim
        out.words = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(table), -1)
        for c in cls.COLUMNS:
            setattr(out, c, table.column(c).to_numpy())
        return out

    def arrays(self) -> list[pa.Array]:
        bits = pa.array([w.tobytes() for w in self.words], pa.binary())
        return [bits, pa.array(self.cell.astype(np.int32)), *(pa.array(getattr(self, c)) for c in self.COLUMNS[1:])]

    def estimate(self, queries: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's inner products with all coded vectors, estimated, and the error that they stay within.

        A query's rotated components are whole multiples of a step, so its
        product with the signs is a sum of bit counts, one for each of its bits.
        """
        turned = queries @ rotation(self.dim).T
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
        whole = np.rint((turned - low) / step).astype(np.uint8)
        ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int32)
        dots = np.zeros((len(queries), len(self.words)), np.int32)
        for j in range(QUERY_BITS):
            plane = packed_bits((whole >> j & 1).astype(bool))
            for w in range(self.words.shape[1]):
                dots += np.bitwise_count(plane[:, w, None] & self.words[None, :, w]).astype(np.int32) << j
        total = whole.sum(axis=1, dtype=np.int64)[:, None] * step + low * self.dim
        far = (2 * (low * ones + step * dots) - total) / np.sqrt(self.dim) - self.middle
        ok = self.fit > 1e-9
        fit = np.where(ok, self.fit, 1.0)
        scale = np.where(ok, self.length / fit, 0.0)
        base = queries @ centroids.T
        apart = np.sqrt(np.maximum(0, (queries**2).sum(axis=1)[:, None] - 2 * base + (centroids**2).sum(axis=1)))
        spread = np.where(ok, self.length * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / math.sqrt(max(1, self.dim - 1)), self.length / EPSILON)
        error = EPSILON * (apart[:, self.cell] * spread + step / math.sqrt(12) * scale) + 1e-9
        return base[:, self.cell] + scale * far, error


def packed_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, padded with zeros."""
    wide = np.zeros((len(signs), -(-signs.shape[1] // 64) * 64), bool)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1).view(np.uint64)


def nearest(codes: Codes, own: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, centroids: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """``(query ids, ids, scores)`` of the ``k`` best of one block for each query.

    The ``FIRST * k`` best by estimate are compared exactly; the k-th of them is
    a floor, and whatever may lie above it by its bound is compared exactly too.
    """
    out = []
    first = min(len(ids), FIRST * k)
    for i in range(0, len(queries), CHUNK):
        estimate, error = codes.estimate(queries[i : i + CHUNK], centroids)
        estimate[ids[None, :] == query_ids[i : i + CHUNK, None]] = -np.inf
        best = np.argpartition(estimate, len(ids) - first, axis=1)[:, len(ids) - first :]
        for j, q in enumerate(queries[i : i + CHUNK]):
            some = best[j][np.isfinite(estimate[j, best[j]])]
            floor = np.sort(own[some] @ q)[-k] - 1e-12 if len(some) >= k else -np.inf
            at = np.flatnonzero(np.isfinite(estimate[j]) & (estimate[j] + error[j] >= floor))
            score = (own[at] * q).sum(axis=1)  # row by row, so equal vectors have equal scores
            top = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(top), query_ids[i + j]), ids[at][top], score[top]))
    return out


def usable(vector):
    """Whether a vector has components, all finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every`` its ``k`` nearest others by cosine.

    Scores are exact cosines of the original vectors in double precision,
    nearest first, ties to the smaller id. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do null ids. Vectors of
    different lengths have no cosine and are no candidates of each other. Rows
    equal in id and vector count once; other rows with the query's id are its
    own and no candidates. A query with fewer candidates gets all; an empty
    table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct().withColumn("dim", F.size("embedding")), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "embedding").toPandas()
    fitted = {int(dim): fit(unit(np.stack(own["embedding"].to_numpy()))) for dim, own in sample.groupby("dim")}
    shared = spark.sparkContext.broadcast(fitted)
    middle = lambda dim: shared.value.get(dim, np.zeros((1, dim)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                codes = Codes(unit(_matrix(part.column("embedding"), dim)), middle(dim))
                yield pa.RecordBatch.from_arrays([*part.columns, *codes.arrays()], names=[*part.schema.names, "bits", *Codes.COLUMNS])

    coded = rows.mapInArrow(code, "vec_id long, embedding array<double>, dim int, bits binary, cell int, length double, fit double, middle double")

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            take = lambda t: (t.column("vec_id").to_numpy(), unit(_matrix(t.column("embedding").combine_chunks(), dim)))
            (ids, own), (query_ids, queries) = take(left), take(right)
            out = nearest(Codes.read(left, dim), own, ids, queries, query_ids, middle(dim), k)
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    # blocks of a bounded size in bytes, of each dimension its own; at least one block a task
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / fits)).cast("int")
    sizes = sizes.select("dim", F.greatest(blocks(F.col("n")), F.least(F.lit(tasks), blocks(F.col("n") * fits / LEAST_ROWS))).alias("cs"), blocks(F.col("q")).alias("qs"))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = F.broadcast(written(sizes, "sizes"))  # a row a dimension
    left = coded.join(sizes, "dim").withColumns({"c": block("cs"), "q": every_block("qs")}).drop("cs", "qs")
    right = rows.where(F.col("vec_id") % every == 0).join(sizes, "dim").withColumns({"c": every_block("cs"), "q": block("qs")}).drop("cs", "qs")
    found = left.groupBy("dim", "c", "q").cogroup(right.groupBy("dim", "c", "q")).applyInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(embeddings: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(embeddings.flatten(), np.float64).reshape(-1, dim)
