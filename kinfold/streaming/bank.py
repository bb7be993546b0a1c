"""The bank of answers as a stream: append-only files in, attempted keys out.

Nothing needs to keep running: ``availableNow`` takes what is new since the
last run, once, and stops.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, confidence string, enrichedAt string, answer string"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """New answers of the bank at ``path``, one JSON object a line."""
    return spark.readStream.schema(SCHEMA).json(path)


def attempted(rows: DataFrame) -> DataFrame:
    """``(key, at)``: each key with a checked answer once, with its first time."""
    good = rows.where("key is not null and confidence is not null").select("key", F.to_timestamp("enrichedAt").alias("at"))
    return good.groupBy("key").agg(F.min("at").alias("at"))


def add_batch(batch: DataFrame, number: int, out: str) -> None:
    """Add the keys of one micro-batch that no other batch has to the table ``out``; a batch that is done again replaces itself.

    What is known lies in the table and not in the stream's state, so however
    late an answer comes, its key gets there.
    """
    spark = batch.sparkSession
    new = attempted(batch)
    try:
        known = spark.read.schema("key string, at timestamp, batch long").parquet(out).where(F.col("batch") != number)
        new = new.join(known.select("key"), "key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("overwrite").parquet(f"{out}/batch={number}")


def take_new(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Bring the table of attempts up to date with the bank."""
    query = answers(spark, path).writeStream.foreachBatch(lambda df, n: add_batch(df, n, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def wave_counts(rows: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Answers by window of time and confidence, late ones up to ``late``."""
    timed = rows.withColumn("at", F.to_timestamp("enrichedAt")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "confidence").agg(F.count("*").alias("n"))
