"""Queries of the grid and track operators over the adapter view, each with its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapter import FIXES_SQL, fixes
from ..functions import geo
from ..operators import grid, tracks

R3 = "floor(({}) * 1e3 + 0.5) / 1e3"
DEG = repr(math.pi / 180)
PI = repr(math.pi)
TWO_PI, FOUR_PI, IN_DEG = repr(2 * math.pi), repr(4 * math.pi), repr(180 / math.pi)
W = f"{geo.WORLD}e0"
WX = f"((({{}}) + 180e0) / 360e0 * {W})"
SIN = f"sin(greatest(-{geo.MAX_LAT!r}, least({geo.MAX_LAT!r}, {{}})) * {DEG})"


def wx(lon: str) -> str:
    return WX.format(lon)


def wy(lat: str) -> str:
    s = SIN.format(lat)
    return f"((0.5e0 - ln((1e0 + {s}) / (1e0 - {s})) / {FOUR_PI}) * {W})"


def cell(v: str) -> str:
    return f"CAST(greatest(0, least({geo.WORLD - 1}, floor({v}))) AS BIGINT)"


def dist(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"sqrt(pow(({lon2} - {lon1}) * (111320e0 * cos(({lat1} + {lat2}) / 2e0 * {DEG})), 2) + pow(({lat2} - {lat1}) * 110574e0, 2))"


def wlon(x: str) -> str:
    return f"(({x}) / {W} * 360e0 - 180e0)"


def wlat(y: str) -> str:
    n = f"({PI} - {TWO_PI} * ({y}) / {W})"
    return f"({IN_DEG} * atan(0.5e0 * (exp({n}) - exp(-{n}))))"


def area(cy: str) -> str:
    return f"pow({geo.EARTH_CIRCUMFERENCE_M / geo.WORLD!r} * cos({wlat(f'CAST({cy} AS DOUBLE) + 0.5e0')} * {DEG}), 2)"


KEY = ["device"]
ORDER = ["t_ms", "fix_id"]
STEPS = f"""
f AS ({FIXES_SQL}),
l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(t_ms) OVER w AS pt FROM f WINDOW w AS (PARTITION BY device ORDER BY t_ms, fix_id)),
s AS (SELECT *, {dist("plon", "plat", "lon", "lat")} AS d FROM l),
b AS (SELECT *, coalesce(t_ms - pt > 1800000, false) OR coalesce(d > 500, false) AS broken FROM s),
parts AS (SELECT *, CAST(sum(CASE WHEN d IS NULL OR broken THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY t_ms, fix_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM b)"""


def samples_sql(source: str, step: str, name: str = "samples") -> str:
    """CTEs that densify ``source`` (with d, plon, plat); a part's first point stands for itself."""
    return f"""
{name}_n AS (SELECT *, d IS NULL OR d > 500 OR broken AS alone,
  CAST(CASE WHEN d IS NULL OR d > 500 OR broken THEN 1 ELSE greatest(1, ceil(d / {step})) END AS BIGINT) AS n,
  {wx("lon")} AS x1, {wy("lat")} AS y1, {wx("plon")} AS px, {wy("plat")} AS py FROM {source}),
{name}_k AS (SELECT *, CASE WHEN alone THEN x1 ELSE px END AS x0, CASE WHEN alone THEN y1 ELSE py END AS y0, unnest(generate_series(1, n)) AS k FROM {name}_n),
{name} AS (SELECT *, {cell("x0 + (x1 - x0) * k / n")} AS cx, {cell("y0 + (y1 - y0) * k / n")} AS cy FROM {name}_k)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    return tracks.split_on_gaps(fixes(spark, d), KEY, ORDER)


def samples(spark: SparkSession, d: str, step: float = tracks.RASTER_STEP_M) -> DataFrame:
    """Samples of tracks: a part's first point has no step before it."""
    rows = parts(spark, d).withColumn("d", F.when(~F.col("broken"), F.col("d")))
    return tracks.densify(rows, step)


def cells_explored(spark, d):
    """Per device: cells, visits, largest count, tiles, area. Distinct cells per track first, so counts shuffle once."""
    cells = grid.track_cells(samples(spark, d), ["device", "part"])
    counts = grid.visits(cells, KEY)
    tile = F.struct(grid.tile_of("cx"), grid.tile_of("cy"))
    return counts.groupBy("device").agg(F.count("*").alias("cells"), F.sum("count").cast("long").alias("visits"), F.max("count").cast("long").alias("most"), F.countDistinct(tile).alias("tiles"), F.sum("cx").cast("long").alias("sum_cx"), F.sum("cy").cast("long").alias("sum_cy"), (F.floor(F.sum(geo.cell_area_m2("cy")) + 0.5)).cast("long").alias("area_m2"))


CELLS_SQL = f"""WITH {STEPS},{samples_sql("parts", "3e0")},
cells AS (SELECT DISTINCT device, part, cx, cy FROM samples),
counts AS (SELECT device, cx, cy, least(255, count(*)) AS count FROM cells GROUP BY device, cx, cy)"""
CELLS_EXPLORED = CELLS_SQL + f"""
SELECT device, count(*) AS cells, CAST(sum(count) AS BIGINT) AS visits, max(count) AS most, count(DISTINCT (cx >> 8, cy >> 8)) AS tiles,
       CAST(sum(cx) AS BIGINT) AS sum_cx, CAST(sum(cy) AS BIGINT) AS sum_cy, CAST(floor(sum({area("cy")}) + 0.5) AS BIGINT) AS area_m2
FROM counts GROUP BY device"""


def mercator(spark, d):
    f = fixes(spark, d)
    rows = f.select("fix_id", geo.cell_x("lon").cast("long").alias("cx"), geo.cell_y("lat").cast("long").alias("cy"))
    tx, ty = F.shiftright("cx", 8), F.shiftright("cy", 8)
    centre = lambda c: F.col(c).cast("double") + F.lit(0.5)
    return rows.select("fix_id", "cx", "cy", tx.alias("tx"), ty.alias("ty"), geo.cell_index(F.col("cx") % 256, F.col("cy") % 256).alias("idx"), geo.tile_key(F.lit(14), tx, ty).alias("key"), geo.tile_id(F.lit(14), tx, ty).alias("id"),
                       geo.parse_tile_key(geo.tile_key(F.lit(14), tx, ty))["ty"].cast("long").alias("parsed_ty"),
                       tracks.round3(geo.world_lon(centre("cx")) * 1000).alias("lon_k"), tracks.round3(geo.world_lat(centre("cy")) * 1000).alias("lat_k"), tracks.round3(geo.cell_area_m2("cy")).alias("area"), tracks.round3(geo.tile_bounds(F.lit(14), tx, ty)["north"] * 1000).alias("north_k"))


MERCATOR = f"""WITH f AS ({FIXES_SQL}), c AS (SELECT fix_id, {cell(wx("lon"))} AS cx, {cell(wy("lat"))} AS cy FROM f)
SELECT fix_id, cx, cy, cx >> 8 AS tx, cy >> 8 AS ty, (cy % 256) * 256 + cx % 256 AS idx, (14 * 16384 + (cx >> 8)) * 16384 + (cy >> 8) AS key,
       '14/' || (cx >> 8) || '/' || (cy >> 8) AS id, cy >> 8 AS parsed_ty,
       {R3.format(wlon("CAST(cx AS DOUBLE) + 0.5e0") + " * 1000")} AS lon_k, {R3.format(wlat("CAST(cy AS DOUBLE) + 0.5e0") + " * 1000")} AS lat_k,
       {R3.format(area("cy"))} AS area, {R3.format(wlat("CAST((cy >> 8) * 256 AS DOUBLE)") + " * 1000")} AS north_k FROM c"""


def distances(spark, d):
    rows = tracks.with_previous(fixes(spark, d), KEY, ORDER).where("d IS NOT NULL")
    b = geo.bearing("plon", "plat", "lon", "lat")
    off = geo.offset_point("lon", "lat", F.lit(250.0), F.lit(60.0))
    return rows.select("fix_id", tracks.round3(F.col("d")).alias("d"), tracks.round3(b).alias("bearing"), tracks.round3(geo.bearing_gap(b, F.lit(350.0))).alias("gap"), tracks.round3(off["lon"] * 1000).alias("off_lon"), tracks.round3(off["lat"] * 1000).alias("off_lat"),
                       tracks.round3(geo.circle_box("lon", "lat", F.lit(500.0))["west"] * 1000).alias("west"), tracks.round3(geo.route_box("plon", "plat", "lon", "lat")["north"] * 1000).alias("north"))


_BEAR = f"(atan2((lon - plon) * (111320e0 * cos((plat + lat) / 2e0 * {DEG})), (lat - plat) * 110574e0) / {DEG} + 360e0)"
DISTANCES = f"""WITH {STEPS}, x AS (SELECT *, {_BEAR} - floor({_BEAR} / 360e0) * 360e0 AS b FROM s WHERE d IS NOT NULL),
y AS (SELECT *, abs(b - 350e0) - floor(abs(b - 350e0) / 360e0) * 360e0 AS g FROM x)
SELECT fix_id, {R3.format("d")} AS d, {R3.format("b")} AS bearing, {R3.format("CASE WHEN g > 180 THEN 360e0 - g ELSE g END")} AS gap,
       {R3.format(f"(lon + 250e0 * sin(60e0 * {DEG}) / (111320e0 * cos(lat * {DEG}))) * 1000")} AS off_lon, {R3.format(f"(lat + 250e0 * cos(60e0 * {DEG}) / 110574e0) * 1000")} AS off_lat,
       {R3.format(f"(lon - 500e0 / (111320e0 * cos(lat * {DEG}))) * 1000")} AS west, {R3.format("(greatest(plat, lat) + greatest(1000e0, 0.6e0 * d) / 110574e0) * 1000")} AS north FROM y"""


def graph_tiles(spark, d):
    f = fixes(spark, d)
    t = f.select("fix_id", geo.graph_tile_x("lon").cast("long").alias("tx"), geo.graph_tile_y("lat").cast("long").alias("ty"))
    cx, cy = geo.pack_cell("tx"), geo.pack_cell("ty")
    key = geo.pack_key(cx, cy)
    return t.select("fix_id", "tx", "ty", key.alias("pack"), geo.pack_file_name(cx, cy).alias("file"), geo.morton_key("tx", "ty").alias("morton"), geo.parse_pack_key(key)["cy"].cast("long").alias("pack_cy"), tracks.round3(geo.graph_tile_bounds("tx", "ty")["south"] * 1000).alias("south_k"))


_MORTON = " + ".join(f"((tx >> {b}) & 1) * {4**b} + ((ty >> {b}) & 1) * {2 * 4**b}" for b in range(16))
GRAPH_TILES = f"""WITH f AS ({FIXES_SQL}), r AS (SELECT fix_id, lon, lat * {PI} / 180e0 AS la FROM f),
t AS (SELECT fix_id, CAST(floor((lon + 180e0) / 360e0 * 4096e0) AS BIGINT) AS tx, CAST(floor((1e0 - ln(tan(la) + 1e0 / cos(la)) / {PI}) / 2e0 * 4096e0) AS BIGINT) AS ty FROM r)
SELECT fix_id, tx, ty, '6/' || (tx >> 6) || '/' || (ty >> 6) AS pack, '6-' || (tx >> 6) || '-' || (ty >> 6) || '.pack' AS file, CAST({_MORTON} AS BIGINT) AS morton, ty >> 6 AS pack_cy,
       {R3.format(f"{IN_DEG} * atan((exp({PI} - {TWO_PI} * (ty + 1) / 4096e0) - exp(-({PI} - {TWO_PI} * (ty + 1) / 4096e0))) / 2e0) * 1000")} AS south_k FROM t"""


def gap_sessions(spark, d):
    rows = parts(spark, d)
    return rows.groupBy("device", "part").agg(F.count("*").alias("points"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), tracks.round3(F.coalesce(F.sum(F.when(~F.col("broken"), F.col("d"))), F.lit(0.0))).alias("length_m"))


GAP_SESSIONS = f"WITH {STEPS} SELECT device, part, count(*) AS points, min(t_ms) AS start_ms, max(t_ms) AS end_ms, {R3.format('coalesce(sum(d) FILTER (NOT broken), 0e0)')} AS length_m FROM parts GROUP BY device, part"


def untimed(f: DataFrame) -> DataFrame:
    """Every seventh fix loses its time; its place in the order stays."""
    return f.withColumn("at", F.col("t_ms")).withColumn("t_ms", F.when(F.col("fix_id") % 7 != 3, F.col("t_ms") * 40))


def day_split(spark, d):
    rows = tracks.split_days(untimed(fixes(spark, d)), KEY, ["at", "fix_id"])
    return rows.groupBy("device", "day_part").agg(F.count("*").alias("points"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("label"), F.min("fix_id").alias("first_fix"))


DAY_SPLIT = f"""WITH f AS ({FIXES_SQL}), u AS (SELECT device, fix_id, t_ms AS pos, CASE WHEN fix_id % 7 <> 3 THEN t_ms * 40 END AS t FROM f),
o AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN CAST(epoch_ms(t) AS DATE) END IGNORE NULLS) OVER (PARTITION BY device ORDER BY pos, fix_id ROWS UNBOUNDED PRECEDING) AS day FROM u),
c AS (SELECT *, lag(day) OVER (PARTITION BY device ORDER BY pos, fix_id) AS before FROM o),
p AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND day <> before THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY pos, fix_id ROWS UNBOUNDED PRECEDING) + 1 AS day_part FROM c)
SELECT device, CAST(day_part AS BIGINT) AS day_part, count(*) AS points, strftime(min(day), '%Y-%m-%d') AS label, min(fix_id) AS first_fix FROM p GROUP BY device, day_part"""


def track_summary(spark, d):
    out = tracks.summaries(fixes(spark, d), KEY, ORDER)
    return out.withColumn("length_m", tracks.round3(F.col("length_m")))


TRACK_SUMMARY = f"WITH {STEPS} SELECT device, count(*) AS points, min(t_ms) AS start_ms, max(t_ms) AS end_ms, {R3.format('coalesce(sum(d) FILTER (d <= 500), 0e0)')} AS length_m FROM s GROUP BY device"


def sources_report(spark, d):
    t = gap_sessions(spark, d).withColumn("source", F.element_at(F.array(*map(F.lit, ("gpx", "timeline", "live"))), (F.col("part") % 3 + 1).cast("int")))
    return t.groupBy("source").agg(F.count("*").alias("tracks"), tracks.round3(F.sum("length_m")).alias("length_m"))


SOURCES_REPORT = f"WITH g AS ({GAP_SESSIONS}) SELECT ['gpx', 'timeline', 'live'][part % 3 + 1] AS source, count(*) AS tracks, {R3.format('sum(length_m)')} AS length_m FROM g GROUP BY 1"


def polyline_cells(spark, d):
    rows = tracks.cells_along(fixes(spark, d), KEY, ORDER)
    return rows.groupBy("device").agg(F.count("*").alias("cells"), F.sum("cx").cast("long").alias("sum_cx"), F.sum("cy").cast("long").alias("sum_cy"))


POLYLINE_CELLS = f"""WITH {STEPS}, raw AS (SELECT * REPLACE (false AS broken) FROM parts),{samples_sql("raw", "4e0")},
r AS (SELECT *, lag(cx) OVER w AS lx, lag(cy) OVER w AS ly FROM samples WINDOW w AS (PARTITION BY device ORDER BY t_ms, fix_id, k))
SELECT device, count(*) AS cells, CAST(sum(cx) AS BIGINT) AS sum_cx, CAST(sum(cy) AS BIGINT) AS sum_cy FROM r WHERE alone OR lx IS NULL OR lx <> cx OR ly <> cy GROUP BY device"""


def log_of(f: DataFrame) -> DataFrame:
    """An ordered write log on a coarse cell: every fifth op is a mask with a value, the others are tracks."""
    return f.select(F.shiftright(geo.cell_x("lon"), 6).cast("long").alias("cx"), F.shiftright(geo.cell_y("lat"), 6).cast("long").alias("cy"), F.col("fix_id").alias("seq"), F.when(F.col("fix_id") % 5 == 0, "max").otherwise("track").alias("kind"), (F.col("fix_id") % 300).alias("v"))


def op_log(spark, d):
    return grid.merged_counts(log_of(fixes(spark, d)).where("kind = 'track' OR v <= 255"), ["cx", "cy"]).withColumn("count", F.col("count").cast("long"))


OP_LOG = f"""WITH f AS ({FIXES_SQL}), o AS (SELECT {cell(wx("lon"))} >> 6 AS cx, {cell(wy("lat"))} >> 6 AS cy, fix_id AS seq, fix_id % 5 = 0 AS mask, fix_id % 300 AS v FROM f WHERE fix_id % 5 <> 0 OR fix_id % 300 <= 255),
a AS (SELECT *, coalesce(sum(CASE WHEN mask THEN 0 ELSE 1 END) OVER (PARTITION BY cx, cy ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM o)
SELECT cx, cy, CAST(least(255, greatest(sum(CASE WHEN mask THEN 0 ELSE 1 END), coalesce(max(v + later) FILTER (mask), 0))) AS BIGINT) AS count FROM a GROUP BY cx, cy"""


def pyramid(spark, d):
    cells = grid.track_cells(samples(spark, d), ["device", "part"])
    levels = grid.pyramid(grid.visits(cells, []))
    return levels.groupBy("level").agg(F.count("*").alias("cells"), F.sum("count").cast("long").alias("visits"), F.max("count").cast("long").alias("most"), F.sum("cx").cast("long").alias("sum_cx")).withColumn("level", F.col("level").cast("long"))


_LEVELS = " UNION ALL ".join(f"SELECT {lv} AS level, cx >> {14 - lv} AS cx, cy >> {14 - lv} AS cy, max(count) AS count FROM base GROUP BY 2, 3" for lv in geo.LEVELS)
PYRAMID = CELLS_SQL + f""", base AS (SELECT cx, cy, least(255, count(*)) AS count FROM cells GROUP BY cx, cy), levels AS ({_LEVELS})
SELECT CAST(level AS BIGINT) AS level, count(*) AS cells, CAST(sum(count) AS BIGINT) AS visits, max(count) AS most, CAST(sum(cx) AS BIGINT) AS sum_cx FROM levels GROUP BY level"""


def remark(spark, d):
    """Versions of a device's track; a version counts what the version just before it did not touch."""
    f = fixes(spark, d)
    rows = f.select(F.col("device").alias("track"), (F.col("fix_id") % 4).alias("version"), F.shiftright(geo.cell_x("lon"), 3).cast("long").alias("cx"), F.shiftright(geo.cell_y("lat"), 3).cast("long").alias("cy")).distinct()
    return grid.fresh_cells(rows).groupBy("track", "version").agg(F.count("*").alias("fresh"))


REMARK = f"""WITH f AS ({FIXES_SQL}), v AS (SELECT DISTINCT device AS track, fix_id % 4 AS version, {cell(wx("lon"))} >> 3 AS cx, {cell(wy("lat"))} >> 3 AS cy FROM f)
SELECT a.track, a.version, count(*) AS fresh FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.track = a.track AND b.version = a.version - 1 AND b.cx = a.cx AND b.cy = a.cy) GROUP BY a.track, a.version"""


def novelty(spark, d):
    """Share of unseen samples of each part of late devices against the cells of early ones."""
    f = samples(spark, d, tracks.NOVELTY_STEP_M)
    seen = f.where("device < 60").select("cx", "cy").distinct()
    out = grid.novelty(f.where("device >= 40"), seen, ["device", "part"])
    return out.withColumn("novelty", tracks.round3(F.col("unseen") / F.col("samples")))


NOVELTY = f"""WITH {STEPS},{samples_sql("parts", "6e0")}, seen AS (SELECT DISTINCT cx, cy FROM samples WHERE device < 60),
near AS (SELECT DISTINCT cx + x AS cx, cy + y AS cy FROM seen, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y))
SELECT s.device, s.part, count(*) AS samples, count(*) FILTER (n.cx IS NULL) AS unseen, {R3.format("CAST(count(*) FILTER (n.cx IS NULL) AS DOUBLE) / count(*)")} AS novelty
FROM samples s LEFT JOIN near n ON n.cx = s.cx AND n.cy = s.cy WHERE s.device >= 40 GROUP BY s.device, s.part"""


def import_log(spark, d):
    f = fixes(spark, d)
    rows = f.select(F.col("fix_id").alias("seq"), (F.col("t_ms") * 3).alias("at_ms"), F.concat(F.lit("src"), (F.col("device") % 7).cast("string")).alias("source"), F.when(F.col("device") % 3 > 0, F.concat(F.lit("f"), (F.col("device") % 3).cast("string"))).alias("file_name"), (F.col("acc") + 1).alias("items"), F.when(F.col("fix_id") % 50 < 46, F.concat(F.lit("part "), F.col("fix_id").cast("string"))).alias("note"))
    return grid.fold_imports(rows).withColumn("note", F.coalesce("note", F.lit("-")))


IMPORT_LOG = f"""WITH f AS ({FIXES_SQL}), r AS (SELECT fix_id AS seq, t_ms * 3 AS at_ms, 'src' || (device % 7) AS source, CASE WHEN device % 3 > 0 THEN 'f' || (device % 3) END AS file_name, acc + 1 AS items, CASE WHEN fix_id % 50 < 46 THEN 'part ' || fix_id END AS note FROM f),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, file_name ORDER BY seq) AS k FROM r),
c AS (
  WITH RECURSIVE w AS (
    SELECT source, file_name, k, at_ms, items, note, at_ms AS start, 1 AS record FROM o WHERE k = 1
    UNION ALL
    SELECT o.source, o.file_name, o.k, o.at_ms, o.items, o.note,
           CASE WHEN o.note IS NOT NULL AND o.at_ms - w.start < 600000 THEN w.start ELSE o.at_ms END,
           CASE WHEN o.note IS NOT NULL AND o.at_ms - w.start < 600000 THEN w.record ELSE w.record + 1 END
    FROM w JOIN o ON o.source = w.source AND o.file_name IS NOT DISTINCT FROM w.file_name AND o.k = w.k + 1)
  SELECT * FROM w)
SELECT source, file_name, CAST(record AS BIGINT) AS record, min(at_ms) AS at_ms, CAST(sum(items) AS BIGINT) AS items, max_by(coalesce(note, '-'), k) AS note
FROM c GROUP BY source, file_name, record"""


def day_merge(spark, d):
    """Pulled points join the stored day tracks; the stored point of a time wins."""
    f = fixes(spark, d).withColumn("t_ms", F.col("t_ms") - F.col("t_ms") % 10000)
    stored = f.where("fix_id % 3 = 0").groupBy("t_ms").agg(F.min_by("lon", "fix_id").alias("lon"), F.min_by("lat", "fix_id").alias("lat")).withColumn("day", F.to_date(F.timestamp_millis("t_ms")))
    new = f.where("fix_id % 3 > 0").withColumnRenamed("fix_id", "arrival")
    out = tracks.merge_into_days(new, stored)
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("points"), F.sum(F.col("is_new").cast("int")).cast("long").alias("added"), tracks.round3(F.sum("lon")).alias("sum_lon"))


DAY_MERGE = f"""WITH f AS ({FIXES_SQL}), q AS (SELECT *, t_ms - t_ms % 10000 AS t FROM f),
old AS (SELECT t, min_by(lon, fix_id) AS lon, 0 AS is_new, 0 AS arrival FROM q WHERE fix_id % 3 = 0 GROUP BY t),
al AS (SELECT * FROM old UNION ALL SELECT t, lon, 1, fix_id FROM q WHERE fix_id % 3 > 0 AND acc <= 50),
m AS (SELECT *, CAST(epoch_ms(t) AS DATE) AS day FROM al QUALIFY row_number() OVER (PARTITION BY t ORDER BY is_new, arrival) = 1)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS points, CAST(sum(is_new) AS BIGINT) AS added, {R3.format("sum(lon)")} AS sum_lon FROM m GROUP BY 1 HAVING max(is_new) = 1"""


PLANS = {
    "cells_explored": (cells_explored, CELLS_EXPLORED),
    "mercator_cells": (mercator, MERCATOR),
    "distances_bearings": (distances, DISTANCES),
    "graph_tiles": (graph_tiles, GRAPH_TILES),
    "gap_sessions": (gap_sessions, GAP_SESSIONS),
    "day_split": (day_split, DAY_SPLIT),
    "track_summary": (track_summary, TRACK_SUMMARY),
    "tracks_by_source": (sources_report, SOURCES_REPORT),
    "polyline_cells": (polyline_cells, POLYLINE_CELLS),
    "op_log_counts": (op_log, OP_LOG),
    "overview_pyramid": (pyramid, PYRAMID),
    "remarked_versions": (remark, REMARK),
    "novelty_of_parts": (novelty, NOVELTY),
    "import_log_fold": (import_log, IMPORT_LOG),
    "day_track_merge": (day_merge, DAY_MERGE),
}
