"""Decisions of the tile prefetcher, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo

#: Least time between rounds, how long a fix outranks the map, how far the map must move to count.
MIN_INTERVAL_MS, FIX_PRIORITY_MS, FAR_PAN_M = 5_000, 60_000, 5_000.0


def map_move_counts(now: Column, fix_at: Column, fix_lon: Column, fix_lat: Column, lon: Column, lat: Column) -> Column:
    far = geo.distance_m(lon, lat, fix_lon, fix_lat) >= FAR_PAN_M
    return F.coalesce(now - fix_at >= FIX_PRIORITY_MS, F.lit(True)) | fix_lon.isNull() | F.coalesce(far, F.lit(False))


def decision(x: Column, y: Column, last_x: Column, last_y: Column, online: Column, save_data: Column, pending: Column, now: Column, last_round: Column) -> Column:
    """'fetch', or why not: no-centre, offline, save-data, unchanged, throttled."""
    same = F.coalesce((x == last_x) & (y == last_y), F.lit(False))
    soon = F.coalesce(now - last_round < MIN_INTERVAL_MS, F.lit(False))
    return F.when(x.isNull() | y.isNull(), "no-centre").when(~online, "offline").when(save_data, "save-data").when(same & ~pending, "unchanged").when(soon, "throttled").otherwise("fetch")
