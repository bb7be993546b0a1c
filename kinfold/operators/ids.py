"""Ids of people: the slug of the name, with the first number that is free."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinfold.functions.text import slug


def assign_ids(people: DataFrame) -> DataFrame:
    """``people(name, first_ord, ...)`` with ``id``, given in order of name, then of ``first_ord``.

    ``jane``, ``jane-2``, ``jane-3``, ... skip what a name has literally, so only
    names of one family, the slug without numbers at its end, can meet. A family
    without literal numbers is numbered by a window; the others, which people
    have to name so, are gone through one by one, with their slugs only.
    """
    base = F.when(slug(F.col("name")) == "", "contact").otherwise(slug(F.col("name")))
    rows = people.select("first_ord", "name", base.alias("base")).withColumn("family", F.regexp_replace("base", "(-[0-9]+)*$", ""))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("family").orderBy(F.collate("name", "UNICODE"), "first_ord")))
    literal = rows.groupBy("family").agg(F.bool_or(F.col("base") != F.col("family")).alias("literal"))
    rows = rows.join(literal, "family").select("first_ord", "base", "family", "place", "literal")

    def one_by_one(family: pd.DataFrame) -> pd.DataFrame:
        used, out, following = set(), [], {}
        for r in family.sort_values("place").itertuples():
            n, got = following.get(r.base, 2), r.base
            while got in used:
                got, n = f"{r.base}-{n}", n + 1
            following[r.base] = n
            used.add(got)
            out.append((r.first_ord, got))
        return pd.DataFrame(out, columns=["first_ord", "id"])

    plain = rows.where("not literal").select("first_ord", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "place")).alias("id"))
    odd = rows.where("literal").groupBy("family").applyInPandas(one_by_one, "first_ord long, id string")
    return people.join(plain.unionByName(odd), "first_ord")
