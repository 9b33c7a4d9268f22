"""Route-quality reports: nearest-rank quantiles, turns, retraced metres, shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def quantiles(df: DataFrame, value: str, by: list[str], qs: tuple = (0.5, 0.9, 1.0)) -> DataFrame:
    """Nearest-rank quantiles, the value at place round(q * (n - 1)): by ranks, as percentile() would interpolate."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda q: F.max(F.when(F.col("k") == F.floor(F.lit(q) * (F.col("n") - 1) + F.lit(0.5)), F.col(value)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[pick(q).alias("max" if q == 1.0 else f"p{round(q * 100)}") for q in qs])


def turns(steps: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """steps (by..., order..., heading_in, heading_out, length_m): turns over 45 degrees and sharp ones over 135 at joints,
    and turns for each kilometre."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = geo.bearing_gap(F.lag("heading_out").over(w), F.col("heading_in"))
    rows = steps.withColumn("turn", d)
    out = rows.groupBy(*by).agg(F.count_if(F.col("turn") > 45).alias("turns"), F.count_if(F.col("turn") > 135).alias("sharp"), F.sum("length_m").alias("length_m"))
    return out.withColumn("turns_per_km", F.col("turns") / F.greatest(F.lit(1e-9), F.col("length_m") / 1000))


def path_totals(arcs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """arcs of paths (by..., order..., segment, length_m, novelty, dismount): a segment's first pass counts as new, later
    ones as retraced."""
    first = F.row_number().over(Window.partitionBy(*by, "segment").orderBy(*order)) == 1
    rows = arcs.withColumn("first", first)
    when = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.sum("length_m").alias("length_m"), when(F.col("first"), F.col("length_m") * F.col("novelty")).alias("new_m"), when(~F.col("first"), F.col("length_m")).alias("retraced_m"), when(F.col("dismount"), F.col("length_m")).alias("dismount_m"))


def about_turns(arcs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Paths with an arc that its reverse follows at once: arcs (by..., order..., arc, reverse)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return arcs.withColumn("before", F.lag("reverse").over(w)).where(F.col("before") == F.col("arc")).select(*by).distinct()


def shared_fraction(a: Column, b: Column) -> Column:
    """Share of the smaller of two arrays of distinct segments that lies in the other; 1 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def compactness(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """4 pi area / length squared of closed polylines, by the shoelace formula around the first point."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kx = F.lit(geo.KX) * F.cos(F.col("lat0") * F.lit(geo.DEG))
    rows = points.withColumn("lon0", F.first("lon").over(whole)).withColumn("lat0", F.first("lat").over(whole))
    rows = rows.withColumn("x", (F.col("lon") - F.col("lon0")) * kx).withColumn("y", (F.col("lat") - F.col("lat0")) * geo.KY)
    rows = rows.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    ring = F.col("x") * F.coalesce("ny", F.lit(0.0)) - F.coalesce("nx", F.lit(0.0)) * F.col("y")  # the first point is the origin
    step = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.abs(F.sum(ring)) / 2).alias("area_m2"), F.coalesce(F.sum(step), F.lit(0.0)).alias("length_m"))
    return out.withColumn("compactness", F.when((F.col("n") >= 3) & (F.col("length_m") > 0), F.lit(4 * math.pi) * F.col("area_m2") / (F.col("length_m") * F.col("length_m"))).otherwise(F.lit(0.0)))


def shard_bytes(packs: DataFrame, cap: int) -> DataFrame:
    return packs.groupBy("shard").agg(F.count("*").alias("cells"), F.sum("bytes").alias("bytes")).withColumn("over_cap", F.col("bytes") > cap)


def flag_counts(calls: DataFrame, kinds: tuple) -> DataFrame:
    """calls (flags array<string>) -> kind, calls: how many have a flag that starts with the kind, 0 too; notes are no flags."""
    real = F.filter("flags", lambda x: ~F.startswith(x, F.lit("note:")))
    has = lambda k: F.count_if(F.exists(real, lambda x: F.startswith(x, F.lit(k))))
    wide = calls.agg(F.count_if(F.size(real) > 0).alias("flagged"), *[has(k).alias(f"n{i}") for i, k in enumerate(kinds)])
    rows = F.array(F.struct(F.lit("flagged").alias("kind"), F.col("flagged").alias("calls")), *[F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").alias("calls")) for i, k in enumerate(kinds)])
    return wide.select(F.explode(rows).alias("x")).select("x.kind", "x.calls")


def class_metres(arcs: DataFrame, by: list[str]) -> DataFrame:
    """arcs (by..., class, length_m) -> metres of each class and its share of all metres of its group."""
    sums = arcs.groupBy(*by, "class").agg(F.sum("length_m").alias("length_m"))
    return sums.withColumn("share", F.col("length_m") / F.sum("length_m").over(Window.partitionBy(*by)))


def length_violations(routes: DataFrame, parts: DataFrame, within_m: float = 1.0) -> DataFrame:
    """routes (route, length_m, new_m), parts (route, kind, length_m, new_m) -> metres by kind of part, and the routes whose own
    sums differ from their parts' by more than a bound, or that claim more new metres than they have."""
    kinds = ("street", "offroad", "straight")
    of = parts.groupBy("route").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length_m"))), F.lit(0.0)).alias(f"{k}_m") for k in kinds], F.sum("length_m").alias("parts_m"), F.sum("new_m").alias("parts_new_m"))
    out = routes.join(of, "route", "left")
    wrong = F.coalesce((F.abs(F.col("length_m") - F.col("parts_m")) > within_m) | (F.abs(F.col("new_m") - F.col("parts_new_m")) > within_m), F.lit(True)) | (F.col("new_m") > F.col("length_m") + within_m)
    return out.select("route", *[F.coalesce(f"{k}_m", F.lit(0.0)).alias(f"{k}_m") for k in kinds], wrong.alias("violation"))
