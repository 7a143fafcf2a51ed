"""Cutting a table into parts by id ranges, so that each part can be read in id order on its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a null id stands: below all others.
LEAST = -(2**63)


def id_cuts(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending ids that cut the rows into about equal parts."""
    if parts < 2:
        return []
    found = ids.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in found})


def part_of(column: str, cuts: list[int]) -> F.Column:
    """The number of the part that an id is in: how many cuts are at or below it. A null id is in part 0."""
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32))

    return part(F.coalesce(F.col(column).cast("long"), F.lit(LEAST)))


def default_parts(df: DataFrame, per: int = 4) -> int:
    return per * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
