"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import drop_written, written


#: Edges up to which the rest is done by one task (16 bytes each): the base case of the rounds, whatever the size before.
LAST_STEP = 1 << 19


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_pydict({"a": pa.array(ids, pa.int64()), "b": pa.array([find(x) for x in ids], pa.int64())})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; component is its smallest vertex.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected
    Components in MapReduce and Beyond", SoCC 2014). A round is two minimum
    aggregations, combined before their shuffle, and two joins, which adaptive
    execution splits where a hub holds many edges. Edges with a null end are
    ignored, self-loops give their vertex a component of its own, and no edges
    give no rows. Every round is written to the shared folder; once few edges are
    left, one task finishes by union-find.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    first = cur = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] <= LAST_STEP:
            done = cur.coalesce(1).mapInArrow(_union_find, "a long, b long")
            break
        if state == before:
            done = cur.groupBy("a").agg(F.min("b").alias("b"))
            break
        # large star: every neighbour above a vertex moves to the vertex's smallest neighbour
        own = cur.where("a <> b")
        both = own.unionAll(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the neighbours below a vertex, and itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        new = written(small.where("a <> b").distinct(), "edges")
        if cur is not first:
            drop_written(cur)
        cur, before = new, state
    if cur is first:
        return done.select(F.col("a").alias("id"), F.col("b").alias("component"))
    vertices = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return vertices.join(done, vertices["id"] == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
