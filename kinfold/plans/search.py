"""Search, filters and statistics over the index of people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import SPACE, text

DEFAULT, MOST, CLI = 15, 25, 50


def haystack() -> Column:
    """What a query looks in, lower case. Phones, addresses, urls and refused claims are not in it."""
    one = [F.col(c) for c in ("name", "profession", "employer", "location", "bio", "notes", "attested.relationship", "attested.context")]
    none = F.array().cast("array<string>")
    many = [F.coalesce(F.map_values("handles"), none), *(F.coalesce(F.col(c), none) for c in ("domains", "roles", "emails", "labels"))]
    parts = F.filter(F.concat(F.array(*one), *many), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.lower(F.array_join(parts, " "))


def matches(query: str, hay: Column | None = None) -> Column:
    """Every word of ``query`` is somewhere in the haystack; an empty query matches."""
    import re

    words = re.split(f"[{SPACE}]+", query.lower()) if query else []
    hay = haystack() if hay is None else hay
    return reduce(lambda a, b: a & b, (F.contains(hay, F.lit(w)) for w in words), F.lit(True))


def has(values: Column, part: str) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(part.lower())))


def within(c: Column, part: str) -> Column:
    return F.contains(F.lower(text(c)), F.lit(part.lower()))


def search(people: DataFrame, query: str = "", *, domain: str | None = None, role: str | None = None, location: str | None = None, employer: str | None = None, confidence: str | None = None, source: str | None = None, tier: str | None = None) -> DataFrame:
    """People that match ``query`` and every filter given; ``source='multi'`` asks for two sources and more."""
    keep = [matches(query)]
    if domain:
        keep.append(has(F.col("domains"), domain))
    if role:
        keep.append(has(F.col("roles"), role) | within(F.col("profession"), role))
    if location:
        keep.append(within(F.col("location"), location))
    if employer:
        keep.append(within(F.col("employer"), employer))
    if confidence:
        keep.append(F.coalesce("confidence", F.lit("none")) == confidence)
    if source:
        keep.append(F.size("sources") >= 2 if source == "multi" else F.coalesce(F.array_contains("sources", source), F.lit(False)))
    if tier:
        keep.append(F.col("tier") == tier)
    return people.where(reduce(lambda a, b: a & b, keep))


def clamp(limit, default: int = DEFAULT, most: int = MOST) -> int:
    """A limit that was asked for, within bounds; the default for what is no positive number."""
    try:
        n = float(limit)
    except (TypeError, ValueError):
        return default
    return min(int(n), most) if 0 < n < float("inf") else default


def stats(people: DataFrame) -> DataFrame:
    """``(kind, value, n)``: people by tier, source, domain and confidence, in one pass."""
    none = F.array().cast("array<string>")
    def each(kind: str, c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = F.concat(
        F.array(F.struct(F.lit("tier").alias("kind"), F.col("tier").alias("value")), F.struct(F.lit("confidence").alias("kind"), F.coalesce("confidence", F.lit("none")).alias("value"))),
        each("source", "sources"), each("domain", "domains"),
    )
    return people.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def top_domains(people: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most common domains; ties by first appearance, whole numbers first."""
    each = people.select("first_ord", F.posexplode("domains").alias("at", "value"))
    by = each.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("first_ord", "at")).alias("first"))
    number = F.when(F.col("value").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("value").cast("long"))
    return by.orderBy(F.desc("n"), number.asc_nulls_last(), "first").limit(k).select("value", "n")
