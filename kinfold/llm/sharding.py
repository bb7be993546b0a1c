"""Sharding by size-tiered compaction under a versioned manifest.

:func:`append` writes arrivals as small immutable shards, one writer task its
own, without a shuffle. :func:`compact` puts runs into tiers by size, gathers
runs of one tier up to the target size, and rewrites a group as one shard if it
holds at least ``FAN`` runs or fills most of a shard; others wait for more of
their size, and runs near the target are left alone. Both commit a new manifest: the full list of shards is written beside the old ones and
renamed to the next version, which fails if another writer took it. Readers
see a version whole or not at all; a task or executor lost on the way leaves
files that no manifest names.

Everything is DataFrame code; documents are shuffled once, by the shard they
go to.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.llm._frames import packed
from kinfold.session import shared_dir, written

#: Bytes of a finished shard as stored, and the documents of an arrival file at most.
TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 2_000
#: Sizes of neighbouring tiers differ by this factor, and so many runs of a tier are merged, unless fewer fill half a shard.
FAN = 4
#: Shards of the manifest that one task packs.
LANE = 100_000
#: Shards up to which files are read by name and joined with a broadcast (about 200 bytes each); beyond that whole folders are read and shuffled by file.
BROADCAST_ROWS = 200_000

FOLDER = "data/v[0-9]{8}-[0-9a-f]{32}"
MANIFEST = "shard string, tier int, n_rows long, n_bytes long"
ROW, SHARD = "row", "shard"


class Conflict(RuntimeError):
    """Another writer committed first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions under ``root``, in order."""
    fs, path, _ = _fs(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version, the newest by default; none before the first commit."""
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v{version or found[-1]:08d}")


def commit(shards: DataFrame, root: str, after: int) -> int:
    """Make ``shards`` the version that follows ``after``: a rename that no second writer can repeat."""
    spark = shards.sparkSession
    hidden = f"{root}/manifest/.{uuid.uuid4().hex}"
    shards.selectExpr("shard", "tier", "n_rows", "n_bytes").write.parquet(hidden)
    fs, source, path = _fs(spark, hidden)
    final = path(f"{root}/manifest/v{after + 1:08d}")
    # an existing directory would take the new one in as its child, so it is looked for on both sides of the rename
    if fs.exists(final) or not fs.rename(source, final) or fs.exists(path(final, source.getName())):
        fs.delete(path(final, source.getName()), True)
        fs.delete(source, True)
        raise Conflict(f"version {after + 1} of {root} exists")
    return after + 1


def tier(n_bytes):
    """0 up to a 64th of the target, then a tier for each factor of ``FAN``."""
    return F.when(n_bytes <= TARGET_BYTES // 64, 0).otherwise(F.ceil(F.log(float(FAN), n_bytes * 64 / TARGET_BYTES))).cast("int")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder`` as shards, with the rows and stored bytes of each."""
    files = _files(spark, [folder]).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("size"))
    found = files.groupBy("shard").agg(F.count("*").alias("n_rows"), F.max("size").alias("n_bytes"))
    return found.select("shard", tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes")


def _folder(root: str, had: list[int]) -> str:
    """A new data folder, named for the version that it is written for."""
    return f"{root}/data/v{(had[-1] if had else 0) + 1:08d}-{uuid.uuid4().hex}"


def append(docs: DataFrame, root: str) -> int:
    """Add ``docs`` under ``root`` as small shards; the new version."""
    spark = docs.sparkSession
    had = versions(spark, root)
    folder = _folder(root, had)
    packed(docs).write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS).parquet(folder)
    return commit(manifest(spark, root).unionByName(_listed(spark, folder)), root, had[-1] if had else 0)


def moves(shards: DataFrame) -> DataFrame:
    """``(shard, into, number)`` for the shards that are rewritten: several of one tier for each new one; ``number`` counts the new ones from 0.

    In lanes that one task can sort, the runs of a tier are taken in order of
    size until the target is full. Runs of half the target and more stay.
    """
    lanes = max(1, -(-shards.count() // LANE))
    small = shards.where(F.col("n_bytes") < TARGET_BYTES // 2).withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)))
    order = W.partitionBy("lane", "tier").orderBy("n_bytes", "shard")
    upto = F.sum("n_bytes").over(order.rowsBetween(W.unboundedPreceding, -1))
    binned = small.withColumn("bin", F.floor(F.coalesce(upto, F.lit(0)) / TARGET_BYTES))
    groups = binned.groupBy("lane", "tier", "bin").agg(F.count("*").alias("c"), F.sum("n_bytes").alias("size"))
    groups = groups.where((F.col("c") >= FAN) | ((F.col("c") > 1) & (F.col("size") >= TARGET_BYTES // 2)))
    own = groups.groupBy("lane").agg(F.count("*").alias("own"))  # a row a lane
    before = own.select(F.col("lane"), (F.sum("own").over(W.orderBy("lane")) - F.col("own")).alias("before"))
    groups = groups.withColumn("place", F.row_number().over(W.partitionBy("lane").orderBy("tier", "bin"))).join(F.broadcast(before), "lane")
    named = groups.select("lane", "tier", "bin", F.concat_ws("-", "lane", "tier", "bin").alias("into"), (F.col("before") + F.col("place") - 1).cast("int").alias("number"))
    return binned.join(named, ["lane", "tier", "bin"]).select("shard", "into", "number")


def compact(spark: SparkSession, root: str) -> int:
    """Merge similarly sized shards into shards of the target size; the version that holds them."""
    had = versions(spark, root)
    if not had:
        return 0
    shards = manifest(spark, root, had[-1])
    plan = written(moves(shards), "moves")
    merged = plan.select("into").distinct().count()
    if not merged:
        return had[-1]
    rows = _rows(spark, plan).select(ROW, "into", "number")
    folder = _folder(root, had)
    # each new shard has a task of its own: hashes of a few names would put several into one
    rows.repartitionById(merged, "number").drop("number").write.option("compression", "zstd").partitionBy("into").parquet(folder)
    kept = shards.join(plan, "shard", "left_anti")
    return commit(kept.unionByName(_listed(spark, folder)), root, had[-1])


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Some files, or the files below some data folders, whether they lie in groups or not."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths)


def _rows(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """``row`` of each document in ``shards(shard, ...)``, of which there is one at least, with their columns: no other file is read while they are few."""
    few = shards.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    path = F.col("shard") if few else F.regexp_extract("shard", f"^(.*/{FOLDER})/.*$", 1)
    paths = [r[0] for r in shards.select(path).distinct().collect()]
    rows = _files(spark, paths).select(ROW, F.col("_metadata.file_path").alias(SHARD))
    return rows.join(F.broadcast(shards) if few else shards, SHARD)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The documents of a version: ``row``, a struct of their columns, and ``shard``, the file, with what the manifest has of it."""
    shards = manifest(spark, root, version)
    if not shards.limit(1).count():
        return spark.createDataFrame([], f"{ROW} struct<doc_id:long>, {MANIFEST}")
    return _rows(spark, shards)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete data folders that none of the newest ``keep`` versions names, and older manifests."""
    live = versions(spark, root)
    fs, data, path = _fs(spark, f"{root}/data")
    named: set[str] = set()
    for v in live[-keep:]:
        named |= {r[0] for r in manifest(spark, root, v).select(F.regexp_extract("shard", f"/({FOLDER})/", 1)).distinct().collect()}
    for s in fs.listStatus(data):
        if f"data/{s.getPath().getName()}" not in named:
            fs.delete(s.getPath(), True)
    for v in live[:-keep]:
        fs.delete(path(f"{root}/manifest/v{v:08d}"), True)


def shard(docs: DataFrame, root: str | None = None) -> DataFrame:
    """``docs`` appended, compacted and committed under ``root``: ``(doc_id, shard, tier, shard_rows, shard_bytes)``.

    Every row goes to one shard, repeated rows each on its own; nulls in any
    column, empty and long texts are stored as they are, and columns of any
    name. ``shard`` names the version that wrote it, its group and its file. An empty table commits
    a version without shards and gives no rows.
    """
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/kinfold/{uuid.uuid4().hex}"
    append(docs, root)
    version = compact(spark, root)
    rows = read(spark, root, version)
    # the version, the group and the writer's numbers, without the random parts of file names
    name = F.concat_ws("/", *(F.regexp_extract("shard", e, 1) for e in (r"/data/(v\d{8})-", r"/into=([^/]+)/", r"/part-(\d+)-", r"[-.]c(\d+)\.")))
    return rows.select("row.doc_id", name.alias("shard"), "tier", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
