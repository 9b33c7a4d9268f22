"""Neighbours in a total order, without one task that sees all rows.

Rows are cut into ranges of the ordering column at quantiles; each range is read in order by one kernel call, and a copy of
each range's first row is also sent to the range before it, so the kernel knows what follows its last row. The cut points
and first rows (one for each range) are all that reaches the driver. Numbers, dates and times are ordered by value, strings
by their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType


def place_of(df: DataFrame, column: str) -> Column:
    """A double that never falls as the column rises. Of strings, the six bytes behind what the least and greatest share."""
    kind = df.schema[column].dataType
    if isinstance(kind, StringType):
        ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
        a, b = ends["a"] or "", ends["b"] or ""
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        digits = F.rpad(F.substring(F.hex(F.encode(F.substring(column, same + 1, 6), "utf-8")), 1, 12), 12, "0")
        return F.conv(digits, 16, 10).cast("double")
    return (F.col(column).cast("timestamp") if isinstance(kind, DateType) else F.col(column)).cast("double")


def cut_points(df: DataFrame, place: Column, n: int) -> list[float]:
    if n < 2:
        return []
    found = df.select(place.alias("x")).where("x IS NOT NULL").approxQuantile("x", [i / n for i in range(1, n)], max(1e-4, 0.1 / n))
    return sorted(set(found))


def with_ranges(df: DataFrame, place: Column, cuts: list[float]) -> DataFrame:
    """Adds ``range_id``: how many cut points lie at or under the place; nulls come first, with range 0."""
    edges = np.array(cuts)

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=float, na_value=-math.inf), side="right").astype(np.int32))

    return df.withColumn("range_id", range_of(place) if cuts else F.lit(0))


def with_followers(df: DataFrame, column: str, n: int, tie: list[str]) -> tuple[DataFrame, int]:
    """df with ``range_id`` and ``follower``: the rows themselves (false), and for each range but the first a copy of its
    first row (true) addressed to the nearest range before it that has rows; the first row of all is also sent to the last
    range, after which the order starts again. Returns it with the number of ranges that have rows.

    Ranges' first rows are found by one aggregation (a row for each range, of the order columns)."""
    place = place_of(df, column)
    ranged = with_ranges(df, place, cut_points(df, place, n))
    order = [column, *tie]
    firsts = ranged.groupBy("range_id").agg(F.min(F.struct(*order)).alias("first")).collect()
    held = sorted(r["range_id"] for r in firsts)
    if not held:
        return ranged.withColumn("follower", F.lit(False)), 0
    before = {b: a for a, b in zip([held[-1], *held], held, strict=False)}
    first = {r["range_id"]: r["first"] for r in firsts}
    schema = "range_id int, " + ", ".join(f"first_{c} {df.schema[c].dataType.simpleString()}" for c in order) + ", before int"
    table = df.sparkSession.createDataFrame([(k, *first[k], before[k]) for k in held], schema)
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    joined = ranged.join(F.broadcast(table), "range_id")  # a row for each range, so at most one for each partition
    own = F.struct(F.col("range_id").alias("range_id"), F.lit(False).alias("follower"))
    sent = F.struct(F.col("before").alias("range_id"), F.lit(True).alias("follower"))
    out = joined.withColumn("to", F.explode(F.when(same, F.array(own, sent)).otherwise(F.array(own))))
    return out.select(*[c for c in df.columns], "to.range_id", "to.follower"), len(held)
