"""Ordered operators over points(key, seq order, lon, lat, t_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Breaks of a track, sampling steps of the raster, of cell lists and of novelty.
GAP_M, GAP_MS = 500.0, 30 * 60_000
RASTER_STEP_M, CELL_STEP_M, NOVELTY_STEP_M = 3.0, 4.0, 6.0


def with_previous(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """points with plon, plat, pt and the distance ``d`` from the point before it in its key (null at the first)."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = points.withColumn("plon", F.lag("lon").over(w)).withColumn("plat", F.lag("lat").over(w)).withColumn("pt", F.lag("t_ms").over(w))
    return out.withColumn("d", geo.distance_m("plon", "plat", "lon", "lat"))


def split_on_gaps(points: DataFrame, key: list[str], order: list[str], gap_m: float = GAP_M, gap_ms: int = GAP_MS) -> DataFrame:
    """Adds ``part`` (from 1): a new one starts beyond a distance, or beyond a time if both points are timed."""
    steps = with_previous(points, key, order)
    broken = F.coalesce(F.col("t_ms") - F.col("pt") > gap_ms, F.lit(False)) | F.coalesce(F.col("d") > gap_m, F.lit(False))
    starts = F.col("d").isNull() | broken
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("broken", broken).withColumn("part", F.sum(starts.cast("int")).over(running))


def split_days(points: DataFrame, key: list[str], order: list[str], tz: str = "UTC") -> DataFrame:
    """Adds ``day_part`` (from 1) and ``day``: untimed points stay with the day before them; a new part starts where the
    day changes, not where the same day comes back later in another run of points."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.to_date(F.from_utc_timestamp(F.timestamp_millis("t_ms"), tz))
    out = points.withColumn("day", F.last(own, ignorenulls=True).over(run))
    before = F.lag("day").over(w)
    change = F.when(before.isNotNull() & (F.col("day") != before), 1).otherwise(0)
    return out.withColumn("change", change).withColumn("day_part", F.sum("change").over(run) + 1).drop("change")


def densify(steps: DataFrame, step_m: float, gap_m: float = GAP_M) -> DataFrame:
    """One row for each sample: rows of with_previous() or split_on_gaps() -> cx, cy and the sample's number k.

    Samples lie at equal parts of the line in world units; a point after a gap, and the first, stand for themselves."""
    alone = F.col("d").isNull() | (F.col("d") > gap_m)
    n = F.when(alone, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("d") / F.lit(step_m)))).cast("int")
    x1, y1 = geo.world_x("lon"), geo.world_y("lat")
    ends = steps.withColumn("alone", alone).withColumn("n", n).withColumn("x1", x1).withColumn("y1", y1)
    ends = ends.withColumn("x0", F.when(F.col("alone"), F.col("x1")).otherwise(geo.world_x("plon"))).withColumn("y0", F.when(F.col("alone"), F.col("y1")).otherwise(geo.world_y("plat")))
    out = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")
    return out.withColumn("cx", geo.clamp_cell(at("x0", "x1"))).withColumn("cy", geo.clamp_cell(at("y0", "y1"))).drop("x0", "x1", "y0", "y1", "alone")


def cells_along(points: DataFrame, key: list[str], order: list[str], step_m: float = CELL_STEP_M) -> DataFrame:
    """The cells of each polyline in order, without consecutive repeats (a gap starts afresh)."""
    samples = densify(with_previous(points, key, order), step_m)
    w = Window.partitionBy(*key).orderBy(*order, "k")
    fresh = (F.col("k") == 1) & (F.col("d").isNull() | (F.col("d") > GAP_M))
    repeat = (F.lag("cx").over(w) == F.col("cx")) & (F.lag("cy").over(w) == F.col("cy")) & ~fresh
    return samples.withColumn("repeat", F.coalesce(repeat, F.lit(False))).where("NOT repeat").drop("repeat")


def summaries(points: DataFrame, key: list[str], order: list[str], gap_m: float = GAP_M) -> DataFrame:
    """points, start_ms, end_ms, length_m of each track; steps longer than the gap do not count."""
    steps = with_previous(points, key, order)
    return steps.groupBy(*key).agg(F.count("*").alias("points"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.coalesce(F.sum(F.when(F.col("d") <= gap_m, F.col("d"))), F.lit(0.0)).alias("length_m"))


def merge_into_days(points: DataFrame, existing: DataFrame, max_accuracy: float = 50.0, tz: str = "UTC") -> DataFrame:
    """Day tracks after new points came: the stored point of a time wins, then the first that arrived.

    points (arrival, t_ms, lon, lat, acc), existing (day, t_ms, lon, lat) -> day, t_ms, lon, lat, is_new for the days that got
    a new point."""
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(c), tz))
    good = points.where((F.col("acc").isNull() | (F.col("acc") <= max_accuracy)) & F.col("t_ms").isNotNull() & geo.is_finite_lon_lat("lon", "lat"))
    new = good.select(day("t_ms").alias("day"), "t_ms", "lon", "lat", F.lit(1).alias("is_new"), "arrival")
    old = existing.select("day", "t_ms", "lon", "lat", F.lit(0).alias("is_new"), F.lit(None).cast(new.schema["arrival"].dataType).alias("arrival"))
    first = F.row_number().over(Window.partitionBy("day", "t_ms").orderBy("is_new", "arrival"))
    merged = old.unionByName(new).withColumn("nth", first).where("nth = 1")
    grown = F.max("is_new").over(Window.partitionBy("day"))
    return merged.withColumn("grown", grown).where("grown = 1").select("day", "t_ms", "lon", "lat", (F.col("is_new") == 1).alias("is_new"))


def round3(c: Column) -> Column:
    return F.floor(c * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)
