"""From records and overlays to the index of people."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinfold.operators.fold import fold
from kinfold.operators.ids import assign_ids
from kinfold.operators.resolve import resolve
from kinfold.session import written


def build_index(records: DataFrame, decisions: DataFrame, enrichments: DataFrame, attested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(people, candidates, warnings)``; people have ids, and order by ``collate(name, 'UNICODE'), first_ord``."""
    groups, candidates, warnings = resolve(records, decisions)
    people = written(fold(records, groups, enrichments, attested), "people")
    return assign_ids(people), candidates, warnings
