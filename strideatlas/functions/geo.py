"""Grid, tile and bearing arithmetic as Column expressions (JVM side, code generated)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cell grid: zoom of a cell, of a tile and of a graph tile, metres per degree, the Earth's girth.
CELL_ZOOM, TILE_ZOOM, GRAPH_ZOOM, PACK_ZOOM = 22, 14, 12, 6
WORLD = 1 << CELL_ZOOM
TILE_SIZE, TILE_SHIFT = 256, CELL_ZOOM - TILE_ZOOM
LEVELS = (14, 10, 6, 2)
MAX_LAT = 85.05112878
EARTH_CIRCUMFERENCE_M = 40_075_016.686
KX, KY = 111_320.0, 110_574.0
DEG = math.pi / 180


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def world_x(lon) -> Column:
    return (col(lon) + F.lit(180.0)) / F.lit(360.0) * F.lit(float(WORLD))


def world_y(lat) -> Column:
    s = F.sin(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), col(lat))) * F.lit(DEG))
    return (F.lit(0.5) - F.log((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(4 * math.pi)) * F.lit(float(WORLD))


def clamp_cell(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(WORLD - 1), F.floor(v))).cast("int")


def cell_x(lon) -> Column:
    return clamp_cell(world_x(lon))


def cell_y(lat) -> Column:
    return clamp_cell(world_y(lat))


def world_lon(x) -> Column:
    return col(x) / F.lit(float(WORLD)) * F.lit(360.0) - F.lit(180.0)


def world_lat(y) -> Column:
    n = F.lit(math.pi) - F.lit(2 * math.pi) * col(y) / F.lit(float(WORLD))
    return F.lit(180 / math.pi) * F.atan(F.lit(0.5) * (F.exp(n) - F.exp(-n)))


def metres_per_cell(lat) -> Column:
    return F.lit(EARTH_CIRCUMFERENCE_M / WORLD) * F.cos(col(lat) * F.lit(DEG))


def cell_area_m2(cy) -> Column:
    m = metres_per_cell(world_lat(col(cy).cast("double") + F.lit(0.5)))
    return m * m


def tile_key(level, tx, ty) -> Column:
    n = F.lit(1 << TILE_ZOOM).cast("long")
    return (col(level).cast("long") * n + col(tx)) * n + col(ty)


def tile_id(level, tx, ty) -> Column:
    return F.concat_ws("/", col(level).cast("string"), col(tx).cast("string"), col(ty).cast("string"))


def parse_tile_key(key) -> Column:
    n, k = F.lit(1 << TILE_ZOOM).cast("long"), col(key)
    return F.struct(F.floor(k / (n * n)).cast("int").alias("level"), (F.floor(k / n).cast("long") % n).cast("int").alias("tx"), (k % n).cast("int").alias("ty"))


def cell_index(ix, iy) -> Column:
    return col(iy) * TILE_SIZE + col(ix)


def mask_to_cell(tile, block, px) -> Column:
    """One coordinate of a visited-tile bitmap position, in cells."""
    return F.shiftleft(col(tile), 13).bitwiseOR(F.shiftleft(col(block), 6)).bitwiseOR(col(px))


def tile_bounds(level, tx, ty) -> Column:
    span = F.lit(TILE_SIZE) * F.pow(F.lit(2.0), F.lit(CELL_ZOOM - 8) - col(level))
    x0, y0 = col(tx) * span, col(ty) * span
    return F.struct(world_lon(x0).alias("west"), world_lat(y0 + span).alias("south"), world_lon(x0 + span).alias("east"), world_lat(y0).alias("north"))


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    dx = (col(lon2) - col(lon1)) * (F.lit(KX) * F.cos((col(lat1) + col(lat2)) / F.lit(2.0) * F.lit(DEG)))
    dy = (col(lat2) - col(lat1)) * F.lit(KY)
    return F.sqrt(dx * dx + dy * dy)


def level_for_zoom(z) -> Column:
    """The coarsest stored level that still has a cell for each pixel."""
    z = col(z)
    return F.when(z >= 14, 14).when(z >= 10, 10).when(z >= 6, 6).otherwise(2)


def graph_tile_x(lon, zoom: int = GRAPH_ZOOM) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((col(lon) + F.lit(180.0)) / F.lit(360.0) * F.lit(float(n))))).cast("int")


def graph_tile_y(lat, zoom: int = GRAPH_ZOOM) -> Column:
    n, la = 1 << zoom, col(lat) * F.lit(math.pi) / F.lit(180.0)
    y = (F.lit(1.0) - F.log(F.tan(la) + F.lit(1.0) / F.cos(la)) / F.lit(math.pi)) / F.lit(2.0) * F.lit(float(n))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(y))).cast("int")


def graph_tile_bounds(tx, ty, zoom: int = GRAPH_ZOOM) -> Column:
    n = float(1 << zoom)
    lon = lambda x: x / F.lit(n) * F.lit(360.0) - F.lit(180.0)
    lat = lambda y: F.lit(180 / math.pi) * F.atan(F.sinh(F.lit(math.pi) - F.lit(2 * math.pi) * y / F.lit(n)))
    return F.struct(lon(col(tx)).alias("west"), lat(col(ty) + 1).alias("south"), lon(col(tx) + 1).alias("east"), lat(col(ty)).alias("north"))


def pack_cell(t, zoom: int = GRAPH_ZOOM) -> Column:
    return F.shiftright(col(t), zoom - PACK_ZOOM)


def pack_key(cx, cy) -> Column:
    return F.concat_ws("/", F.lit(str(PACK_ZOOM)), col(cx).cast("string"), col(cy).cast("string"))


def pack_file_name(cx, cy, suffix: str = "pack") -> Column:
    return F.concat(F.concat_ws("-", F.lit(str(PACK_ZOOM)), col(cx).cast("string"), col(cy).cast("string")), F.lit(f".{suffix}"))


def parse_pack_key(key) -> Column:
    """struct(cx, cy), or null if it is no key of this zoom."""
    pattern = rf"^{PACK_ZOOM}/(\d+)/(\d+)$"
    part = lambda i: F.regexp_extract(col(key), pattern, i).cast("int")
    return F.when(F.coalesce(col(key).rlike(pattern), F.lit(False)), F.struct(part(1).alias("cx"), part(2).alias("cy")))


def spread_bits(v: Column) -> Column:
    """Puts 16 bits on every second place, by halving blocks."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton_key(x, y) -> Column:
    low = lambda v: col(v).bitwiseAND(F.lit(0xFFFF))
    return spread_bits(low(x)).bitwiseOR(F.shiftleft(spread_bits(low(y)), 1))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    kx = F.lit(KX) * F.cos((col(lat1) + col(lat2)) / F.lit(2.0) * F.lit(DEG))
    raw = F.atan2((col(lon2) - col(lon1)) * kx, (col(lat2) - col(lat1)) * F.lit(KY)) / F.lit(DEG) + F.lit(360.0)
    return raw - F.floor(raw / F.lit(360.0)) * F.lit(360.0)


def bearing_gap(a, b) -> Column:
    d = F.abs(col(a) - col(b))
    d = d - F.floor(d / F.lit(360.0)) * F.lit(360.0)
    return F.when(d > 180, F.lit(360.0) - d).otherwise(d)


def offset_point(lon, lat, dist_m, bearing_deg) -> Column:
    b = col(bearing_deg) * F.lit(DEG)
    return F.struct((col(lon) + col(dist_m) * F.sin(b) / (F.lit(KX) * F.cos(col(lat) * F.lit(DEG)))).alias("lon"), (col(lat) + col(dist_m) * F.cos(b) / F.lit(KY)).alias("lat"))


def is_finite_lon_lat(lon, lat) -> Column:
    ok = ~F.isnan(col(lon)) & ~F.isnan(col(lat)) & col(lon).between(-180.0, 180.0) & col(lat).between(-90.0, 90.0)
    return F.coalesce(ok, F.lit(False))


def circle_box(lon, lat, radius_m) -> Column:
    """Bounding box of a circle."""
    dx, dy = col(radius_m) / (F.lit(KX) * F.cos(col(lat) * F.lit(DEG))), col(radius_m) / F.lit(KY)
    return F.struct((col(lon) - dx).alias("west"), (col(lat) - dy).alias("south"), (col(lon) + dx).alias("east"), (col(lat) + dy).alias("north"))


def route_box(lon1, lat1, lon2, lat2) -> Column:
    """Box of a route request: its ends, padded by 0.6 of their distance and 1 km at least."""
    pad = F.greatest(F.lit(1000.0), F.lit(0.6) * distance_m(lon1, lat1, lon2, lat2))
    mid = (col(lat1) + col(lat2)) / F.lit(2.0)
    dx, dy = pad / (F.lit(KX) * F.cos(mid * F.lit(DEG))), pad / F.lit(KY)
    return F.struct((F.least(lon1, lon2) - dx).alias("west"), (F.least(lat1, lat2) - dy).alias("south"), (F.greatest(lon1, lon2) + dx).alias("east"), (F.greatest(lat1, lat2) + dy).alias("north"))
