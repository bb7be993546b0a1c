"""Strong identifiers of records, their first holders, and the star of edges around each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.names import match_tokens, name_tokens
from kinfold.functions.text import linkedin_key, norm_email, norm_phone, trim

#: Kinds in the order in which a record's identifiers are met.
KINDS = ("email", "phone", "handle", "linkedin", "did")


def _list(rank: int, values: Column, kind, value) -> Column:
    return F.transform(values, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("at"), kind(x).alias("type"), value(x).alias("value")))


def identifiers(records: DataFrame) -> DataFrame:
    """``(ord, rank, at, type, value)`` for every identifier of ``records``; junk has none.

    A place in the order is ``(ord, rank, at)``.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    handles = F.map_entries(F.coalesce(F.col("handles"), F.create_map().cast("map<string,string>")))
    did = F.when(trim(F.col("did")).rlike(r"(?i)^did:[a-z0-9]+:.+"), trim(F.col("did")))
    both = F.concat(
        _list(0, listed("emails"), lambda x: F.lit("email"), norm_email),
        _list(1, listed("phones"), lambda x: F.lit("phone"), norm_phone),
        _list(2, handles, lambda x: F.concat(F.lit("handle-"), x["key"]), lambda x: F.lower(trim(x["value"]))),
        _list(3, listed("urls"), lambda x: F.lit("linkedin"), linkedin_key),
        _list(4, F.array(did), lambda x: F.lit("did"), lambda x: x),
    )
    found = records.select("ord", F.explode(F.filter(both, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("x"))
    return found.select("ord", "x.*")


def first_holders(found: DataFrame) -> DataFrame:
    """``(type, value, holder)``: the record that has an identifier first."""
    return found.groupBy("type", "value").agg(F.min("ord").alias("holder"))


def star_edges(records: DataFrame) -> DataFrame:
    """``(holder, ord, rank, at, type, value, kind)``: each later holder with the first one only.

    ``kind``: ``union``; ``deferred`` where an e-mail or phone is shared by
    names of two tokens and more that do not match; ``warn`` where another
    identifier joins such names that have nothing in common.
    """
    found = identifiers(records)
    edges = found.join(first_holders(found), ["type", "value"]).where("ord <> holder")
    names = records.select("ord", name_tokens(F.col("name")).alias("tokens"))
    a = names.withColumnsRenamed({"ord": "holder", "tokens": "ta"})
    joined = edges.join(a, "holder").join(names.withColumnRenamed("tokens", "tb"), "ord")
    score = match_tokens(F.col("ta"), F.col("tb"))
    both = (F.size("ta") >= 2) & (F.size("tb") >= 2)
    shared = F.col("type").isin("email", "phone")
    kind = F.when(shared & both & (score < 0.8), "deferred").when(~shared & both & (score == 0), "warn").otherwise("union")
    return joined.select("holder", "ord", "rank", "at", "type", "value", kind.alias("kind"))
