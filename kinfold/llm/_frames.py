"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def adding(df: DataFrame, fields: list[StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with ``fields`` made from each Arrow batch; a column of ``df`` with such a name is replaced."""
    df = df.drop(*(f.name for f in fields))
    schema = StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=schema.names)

    return df.mapInArrow(run, schema)


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, ``text`` as a string; what else ``df`` has plays no part."""
    return df.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in columns))


def named(column: str) -> Column:
    """The column of exactly that name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside ``more`` made from them; so no name can clash."""
    return df.select(F.struct(*map(named, df.columns)).alias("row"), *more)


def columns(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``df`` out of ``row``, those in ``new`` replaced."""
    return [(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in df.columns]
