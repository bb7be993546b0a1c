"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Folders of applications that are deleted when they end.
_ENDING: set[str] = set()


def builder(app: str = "kinfold") -> SparkSession.Builder:
    """A session builder with the settings that results depend on."""
    return SparkSession.builder.appName(app).config(map=SETTINGS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (a local session, as in tests) a
    temporary folder of this machine is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts lineage like ``checkpoint()``, survives lost executors, and keeps
    columns encoded, so it takes less disk than serialized rows. What an
    application wrote so goes when it ends.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if own not in _ENDING:
        _ENDING.add(own)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` returned and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
