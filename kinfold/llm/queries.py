"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, jaccard, language, lines, mixing, neighbours, privacy, quality, sharding, spans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(_table(spark, sf_dir, "documents"), ends=True)


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_quality, op3_mixing, op4_language, op5_neighbours, op6_privacy, op7_lines, op8_decontamination, op9_sharding, op10_spans)}
ORACLE_SQL: dict[str, str] = {"op1_jaccard": jaccard.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op7_lines": lines.ORACLE_SQL}
