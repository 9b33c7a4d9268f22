"""Queries of formatting and codec functions, reports, streams' batch twins and formats, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import FIXES_SQL, fixes
from ..functions import geo
from ..functions import text as T
from ..operators import grid, handoff, raster, reports, tracks
from ..sources import gpx, importer, receiver
from ..streaming import session
from .explore import R3, STEPS, dist, samples

IDS = ("us/new-york", "canada/british-columbia", "prince-edward-island", "isle-of-the-sea", "mexico")
LINES = ("Geofabrik us/delaware, ontario (+ border merge)", "us/new-york 2026-09-02, us/new-york, Bad Id", "", "geofabrik mexico")


def pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def pick_sql(values, n):
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


def formats(spark, d):
    f = fixes(spark, d).select("fix_id", "acc", "t_ms")
    m = F.col("fix_id") * F.lit(3.7)
    return f.select("fix_id", T.distance(m).alias("metric"), T.distance(m, "imperial").alias("imperial"), T.distance_tidy(m).alias("tidy"), T.area(m * 1000).alias("area"), T.minutes(m / 60).alias("minutes"), T.elapsed(m).alias("elapsed"), T.percent(F.col("acc") / 1.2).alias("percent"),
                    T.bytes_text(F.col("fix_id") * 997).alias("bytes"), T.age(F.col("fix_id") * 61_000).alias("age"), T.batch_suffix(F.col("t_ms"), F.col("fix_id") * 31).alias("suffix"), T.key_epoch(F.concat(F.lit("tok/"), T.batch_suffix(F.col("t_ms"), F.col("fix_id")))).alias("epoch"))


def _fix(x, digits=1):
    return f"printf('%.{digits}f', ({x}) + CASE WHEN ({x}) * {2 ** (digits + 1)} % 2 = 1 THEN 1e-{digits + 3} ELSE 0 END)"


_M = "(fix_id * 3.7e0)"
_W = lambda x: f"CAST(CAST(floor({x} + 0.5e0) AS BIGINT) AS VARCHAR)"
_MET = f"CASE WHEN {_M} < 950 THEN CAST(CAST(floor({_M} / 10e0 + 0.5e0) * 10 AS BIGINT) AS VARCHAR) || ' m' ELSE CASE WHEN {_M} / 1e3 < 10 THEN {_fix(_M + ' / 1e3')} ELSE {_W(f'{_M} / 1e3')} END || ' km' END"
FORMATS = f"""WITH f AS ({FIXES_SQL}), x AS (SELECT *, CAST(floor({_M} / 60e0 + 0.5e0) AS BIGINT) AS mi, CAST(floor({_M}) AS BIGINT) AS s, fix_id * 997 AS b, CAST(floor(fix_id * 61000 / 60000e0 + 0.5e0) AS BIGINT) AS am FROM f),
y AS (SELECT *, CAST(floor(am / 60e0 + 0.5e0) AS BIGINT) AS ah FROM x)
SELECT fix_id, {_MET} AS metric,
  CASE WHEN {_M} / 1609.344e0 < 0.19e0 THEN CAST(CAST(floor({_M} / 0.3048e0 / 10e0 + 0.5e0) * 10 AS BIGINT) AS VARCHAR) || ' ft' ELSE CASE WHEN {_M} / 1609.344e0 < 10 THEN {_fix(_M + ' / 1609.344e0')} ELSE {_W(f'{_M} / 1609.344e0')} END || ' mi' END AS imperial,
  regexp_replace({_MET}, '\\.0 ', ' ') AS tidy,
  CASE WHEN {_M} * 1000 / 1e6 < 1 THEN {_fix(_M + ' * 1000 / 1e6', 2)} WHEN {_M} * 1000 / 1e6 < 10 THEN {_fix(_M + ' * 1000 / 1e6')} ELSE {_W(f'{_M} * 1000 / 1e6')} END || ' km²' AS area,
  CASE WHEN mi < 60 THEN mi || ' min' WHEN mi % 60 = 0 THEN (mi // 60) || ' h' ELSE (mi // 60) || ' h ' || lpad(CAST(mi % 60 AS VARCHAR), 2, '0') || ' min' END AS minutes,
  CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed,
  {_W("acc / 1.2e0")} || '%' AS percent,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {_W("b / 1024e0")} || ' KB' WHEN b < 10485760 THEN {_fix('b / 1048576e0')} || ' MB' ELSE {_W("b / 1048576e0")} || ' MB' END AS bytes,
  CASE WHEN am < 1 THEN 'just now' WHEN am < 60 THEN am || ' min ago' WHEN ah < 48 THEN ah || ' h ago' ELSE {_W("ah / 24e0")} || ' days ago' END AS age,
  lpad(CAST(t_ms AS VARCHAR), 13, '0') || '-' || lpad(CAST(fix_id * 31 % 100000 AS VARCHAR), 5, '0') AS suffix, t_ms AS epoch FROM y"""


def names(spark, d):
    f = fixes(spark, d).select("fix_id", "lon", "lat")
    region, line = pick(IDS, F.col("fix_id")), pick(LINES, F.col("fix_id"))
    token = F.concat(F.lit("tok_"), (F.col("fix_id") * 7919).cast("string"))
    return f.select("fix_id", T.region_name(region).alias("name"), T.region_country(region).alias("country"), F.array_join(T.source_regions(line), ",").alias("sources"), T.slug(F.concat(F.lit("Étude n° "), F.col("fix_id").cast("string"), F.lit(" — Domino Park!"))).alias("slug"),
                    T.lat_lng(F.col("lon"), F.col("lat")).alias("lat_lng"), T.mask_token(token).alias("mask"), T.valid_token(token).cast("int").cast("long").alias("valid"), T.receiver_url(F.concat(F.lit(" https://x.example/"), F.col("fix_id").cast("string"), F.lit("/?q=1#h "))).alias("url"), T.fnv1a(token).alias("hash"))


NAMES = f"""WITH f AS ({FIXES_SQL}), t AS (SELECT *, 'tok_' || (fix_id * 7919) AS tok FROM f)
SELECT fix_id, {pick_sql(("New York", "British Columbia", "Prince Edward Island", "Isle of the Sea", "Mexico"), "fix_id")} AS name, {pick_sql(("US", "Canada", "", "", ""), "fix_id")} AS country,
  {pick_sql(("us/delaware,ontario", "us/new-york", "", "mexico"), "fix_id")} AS sources, 'etude-n-' || fix_id || '-domino-park' AS slug, printf('%.5f', lat) || ',' || printf('%.5f', lon) AS lat_lng,
  CASE WHEN length(tok) <= 8 THEN '••••' ELSE substr(tok, 1, 4) || '…' || right(tok, 4) END AS mask, CAST(length(tok) >= 8 AS BIGINT) AS valid, 'https://x.example/' || fix_id AS url,
  CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(tok, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS BIGINT) AS hash FROM t"""


def render_scalars(spark, d):
    f = fixes(spark, d)
    z = (F.col("fix_id") % 20).cast("int")
    return f.select("fix_id", tracks.round3(T.heat_intensity(F.col("acc")) * 100).alias("intensity"), tracks.round3(T.smoothstep(0.3, 0.85, F.col("acc") / 120) * 100).alias("step"), geo.level_for_zoom(z).cast("long").alias("level"), T.retry_delay((F.col("fix_id") % 9 + 1).cast("int"), F.when(F.col("fix_id") % 5 == 0, F.col("acc") * 1000)).alias("delay"))


_U = "greatest(0e0, least(1e0, (acc / 120e0 - 0.3e0) / 0.55e0))"
RENDER_SCALARS = f"""WITH f AS ({FIXES_SQL}) SELECT fix_id, {R3.format("CASE WHEN acc > 0 THEN 0.22e0 + 0.78e0 * least(1e0, (acc - 1) / 7e0) ELSE 0e0 END * 100")} AS intensity,
  {R3.format(f"{_U} * {_U} * (3e0 - 2e0 * {_U}) * 100")} AS step, CASE WHEN fix_id % 20 >= 14 THEN 14 WHEN fix_id % 20 >= 10 THEN 10 WHEN fix_id % 20 >= 6 THEN 6 ELSE 2 END AS level,
  CASE WHEN fix_id % 5 = 0 THEN acc * 1000e0 ELSE least(60000e0 * pow(2e0, fix_id % 9), 3600000e0) END AS delay FROM f"""


def quantile_report(spark, d):
    return reports.quantiles(fixes(spark, d).select("device", "acc"), "acc", ["device"])


QUANTILES = f"""WITH k AS (SELECT device, acc, row_number() OVER (PARTITION BY device ORDER BY acc) - 1 AS k, count(*) OVER (PARTITION BY device) AS n FROM ({FIXES_SQL}))
SELECT device, count(*) AS n, max(acc) FILTER (k = floor(0.5e0 * (n - 1) + 0.5e0)) AS p50, max(acc) FILTER (k = floor(0.9e0 * (n - 1) + 0.5e0)) AS p90, max(acc) AS max FROM k GROUP BY device"""


def shapes(spark, d):
    out = reports.compactness(fixes(spark, d), ["device"], ["t_ms", "fix_id"])
    return out.select("device", "n", tracks.round3(F.col("area_m2") / 1000).alias("area_k"), tracks.round3(F.col("length_m")).alias("length_m"), tracks.round3(F.col("compactness") * 1e6).alias("compact"))


_KX = "(111320e0 * cos(lat0 * 0.017453292519943295e0))"
SHAPES = f"""WITH f AS ({FIXES_SQL}), o AS (SELECT *, first_value(lon) OVER w AS lon0, first_value(lat) OVER w AS lat0 FROM f WINDOW w AS (PARTITION BY device ORDER BY t_ms, fix_id)),
p AS (SELECT device, t_ms, fix_id, (lon - lon0) * {_KX} AS x, (lat - lat0) * 110574e0 AS y FROM o), q AS (SELECT *, lead(x) OVER v AS nx, lead(y) OVER v AS ny FROM p WINDOW v AS (PARTITION BY device ORDER BY t_ms, fix_id)),
a AS (SELECT device, count(*) AS n, abs(sum(x * coalesce(ny, 0) - coalesce(nx, 0) * y)) / 2 AS area, coalesce(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 0) AS len FROM q GROUP BY device)
SELECT device, n, {R3.format("area / 1000")} AS area_k, {R3.format("len")} AS length_m, {R3.format("CASE WHEN n >= 3 AND len > 0 THEN 12.566370614359172e0 * area / (len * len) ELSE 0 END * 1e6")} AS compact FROM a"""


def path_report(spark, d):
    """Fixes as steps of paths over coarse cells: totals with each segment's first pass."""
    f = fixes(spark, d).select("device", "fix_id", (F.floor(F.col("lon") * 2000) * 100_000 + F.floor(F.col("lat") * 2000)).cast("long").alias("segment"), (F.col("acc") + 1).cast("double").alias("length_m"), (F.col("fix_id") % 5 / 4).alias("novelty"), (F.col("fix_id") % 7 == 0).alias("dismount"))
    out = reports.path_totals(f, ["device"], ["fix_id"])
    return out.select("device", *[tracks.round3(F.col(c)).alias(c) for c in ("length_m", "new_m", "retraced_m", "dismount_m")])


PATHS = f"""WITH s AS (SELECT device, fix_id, CAST(floor(lon * 2000) * 100000 + floor(lat * 2000) AS BIGINT) AS g, acc + 1e0 AS m, (fix_id % 5) / 4e0 AS nov, fix_id % 7 = 0 AS dis FROM ({FIXES_SQL})),
k AS (SELECT *, row_number() OVER (PARTITION BY device, g ORDER BY fix_id) = 1 AS one FROM s)
SELECT device, {R3.format("sum(m)")} AS length_m, {R3.format("coalesce(sum(m * nov) FILTER (one), 0)")} AS new_m, {R3.format("coalesce(sum(m) FILTER (NOT one), 0)")} AS retraced_m, {R3.format("coalesce(sum(m) FILTER (dis), 0)")} AS dismount_m FROM k GROUP BY device"""


def live_filter(spark, d):
    out = session.accepted(fixes(spark, d))
    return out.select("device", "fix_id", tracks.round3(F.col("distance_m")).alias("distance_m"), "dropped")


_D = dist("w.lon", "w.lat", "f.lon", "f.lat")
LIVE_FILTER = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t_ms, fix_id) AS k FROM ({FIXES_SQL})),
w AS (
  SELECT device, k, fix_id, lon, lat, t_ms, 0e0 AS total, CASE WHEN acc > 50 THEN 1 ELSE 0 END AS dropped, acc <= 50 AS started, acc <= 50 AS taken FROM f WHERE k = 1
  UNION ALL
  SELECT device, k, fix_id, CASE WHEN taken THEN nlon ELSE lon END, CASE WHEN taken THEN nlat ELSE lat END, CASE WHEN taken THEN nt ELSE t_ms END,
         CASE WHEN taken AND started AND step < 500 THEN total + step ELSE total END, dropped + CASE WHEN bad THEN 1 ELSE 0 END, started OR taken, taken
  FROM (SELECT *, NOT bad AND (NOT started OR step >= 1.5) AS taken FROM (
    SELECT f.device, f.k, f.fix_id, w.lon, w.lat, w.t_ms, w.total, w.dropped, w.started, f.lon AS nlon, f.lat AS nlat, f.t_ms AS nt, {_D} AS step,
           f.acc > 50 OR (w.started AND (f.t_ms <= w.t_ms OR {_D} / greatest((f.t_ms - w.t_ms) / 1e3, 0.5e0) > 60)) AS bad
    FROM w JOIN f ON f.device = w.device AND f.k = w.k + 1)))
SELECT device, fix_id, {R3.format("total")} AS distance_m, CAST(dropped AS BIGINT) AS dropped FROM w WHERE taken"""


def posted(spark, d):
    """GeoJSON batches made from fixes, read back by the receiver's rules."""
    f = fixes(spark, d)
    place = F.format_string('{"geometry":{"type":"Point","coordinates":[%.6f,%.6f]},"properties":{"timestamp":"%s","horizontal_accuracy":"%d","speed":"%d","device_id":"dev-%d"}}', F.when(F.col("fix_id") % 23 == 0, F.lit(500.0)).otherwise(F.col("lon")), F.col("lat"), F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("acc") - 20, F.col("fix_id") % 9 - 2, F.col("device"))
    rows = f.select("device", F.floor(F.col("fix_id") / 600).cast("long").alias("batch"), F.struct((-F.col("fix_id")).alias("o"), place.alias("j")).alias("x"))
    posts = rows.groupBy("device", "batch").agg(F.concat(F.lit('{"locations":['), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]}")).alias("body"))
    out = receiver.compact(posts).withColumnRenamed("device", "device_text").withColumn("device", F.regexp_extract("device_text", r"(\d+)", 1).try_cast("long"))
    return out.select(F.coalesce("device", F.lit(-1)).alias("device"), "batch", F.col("dropped").cast("long").alias("dropped"), F.size("points").cast("long").alias("points"), F.coalesce(F.get(F.col("points"), 0)["t"], F.lit(-1)).alias("first_t"), F.size(F.filter("points", lambda p: p["acc"].isNotNull())).cast("long").alias("with_acc"), F.size(F.filter("points", lambda p: p["speed"].isNotNull())).cast("long").alias("with_speed"))


POSTED = f"""WITH f AS (SELECT *, fix_id // 600 AS batch, fix_id % 23 = 0 AS bad FROM ({FIXES_SQL}))
SELECT CASE WHEN bool_and(bad) THEN -1 ELSE device END AS device, batch, count(*) FILTER (bad) AS dropped, count(*) FILTER (NOT bad) AS points, coalesce(min(t_ms) FILTER (NOT bad), -1) AS first_t,
  count(*) FILTER (NOT bad AND acc >= 20) AS with_acc, count(*) FILTER (NOT bad AND fix_id % 9 >= 2) AS with_speed FROM f GROUP BY device, batch"""


def pulled(spark, d):
    f = fixes(spark, d).select(T.batch_suffix(F.col("t_ms"), F.col("fix_id")).alias("key"), F.col("t_ms").alias("received"))
    return receiver.pull(f, "1704067300000-00000").withColumn("has_more", F.col("has_more").cast("int").cast("long"))


PULLED = f"""SELECT key, received, CAST(1 AS BIGINT) AS has_more FROM (SELECT lpad(CAST(t_ms AS VARCHAR), 13, '0') || '-' || lpad(CAST(fix_id % 100000 AS VARCHAR), 5, '0') AS key, t_ms AS received FROM ({FIXES_SQL}))
WHERE key > '1704067300000-00000' ORDER BY key LIMIT 25"""


def gpx_round_trip(spark, d):
    """Tracks of devices written as GPX and read again by the importer."""
    f = fixes(spark, d)
    t = f.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("t_ms", "lon", "lat"))).alias("p"))
    t = t.select(F.col("device").cast("string").alias("track_id"), F.concat(F.lit("Q & <"), F.col("device").cast("string"), F.lit(">")).alias("name"), F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["t_ms"].alias("t_ms"))).alias("points"))
    files = gpx.to_gpx(t).select(F.concat(F.lit("d"), "track_id", F.lit(".gpx")).alias("path"), F.encode("gpx", "UTF-8").alias("content"))
    p = importer.points(files)
    return p.groupBy(F.regexp_extract("file", r"d(\d+)", 1).cast("long").alias("device"), "name").agg(F.count("*").alias("points"), F.countDistinct("track_id").alias("parts"), F.min("t_ms").alias("start_ms"), F.sum(F.floor(F.col("lon") * 1e5 + 0.5)).cast("long").alias("sum_lon"))


GPX_ROUND_TRIP = f"""WITH {STEPS}
SELECT device, 'Q & <' || device || '>' AS name, count(*) AS points, max(part) AS parts, min(t_ms) AS start_ms, CAST(sum(floor(lon * 1e5 + 0.5)) AS BIGINT) AS sum_lon FROM parts GROUP BY device"""


def timeline_records(spark, d):
    """Legacy location records made from fixes and read by the importer: fixes under 100 m, cut at days and gaps."""
    f = fixes(spark, d)
    entry = F.format_string('{"latitudeE7":%d,"longitudeE7":%d,"accuracy":%d,"timestampMs":"%d"}', F.floor(F.col("lat") * 1e7 + 0.5).cast("long"), F.floor(F.col("lon") * 1e7 + 0.5).cast("long"), F.col("acc"), F.col("t_ms"))
    docs = f.groupBy("device").agg(F.concat(F.lit('{"locations":['), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("]}")).alias("j"))
    p = importer.points(docs.select(F.concat(F.lit("d"), F.col("device").cast("string"), F.lit(".json")).alias("path"), F.encode("j", "UTF-8").alias("content")))
    return p.groupBy(F.regexp_extract("file", r"d(\d+)", 1).cast("long").alias("device")).agg(F.count("lon").alias("points"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))


TIMELINE_RECORDS = f"SELECT device, count(*) AS points, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM ({FIXES_SQL}) WHERE acc <= 100 GROUP BY device"


def fog_tiles(spark, d):
    cells = grid.track_cells(samples(spark, d), ["device", "part"])
    levels = grid.pyramid(grid.visits(cells, []))
    asked = spark.range(12, 17).select(F.col("id").cast("int").alias("z"))
    asked = asked.select("z", geo.graph_tile_x(F.lit(-73.95), 16).alias("x16"), geo.graph_tile_y(F.lit(40.65), 16).alias("y16")).select("z", F.expr("shiftright(x16, 16 - z)").alias("x"), F.expr("shiftright(y16, 16 - z)").alias("y"))
    return raster.tiles(asked, levels, 256).select("z", "x", "y", F.length("rgba").alias("bytes"))


FOG_TILES = """SELECT CAST(z AS INTEGER) AS z, CAST(floor((-73.95e0 + 180e0) / 360e0 * 65536e0) AS BIGINT) >> (16 - z) AS x,
  CAST(floor((1e0 - ln(tan(40.65e0 * 3.141592653589793e0 / 180e0) + 1e0 / cos(40.65e0 * 3.141592653589793e0 / 180e0)) / 3.141592653589793e0) / 2e0 * 65536e0) AS BIGINT) >> (16 - z) AS y, 262144 AS bytes FROM (SELECT unnest(range(12, 17)) AS z)"""


def handoff_parts(spark, d):
    f = fixes(spark, d)
    r = f.groupBy(F.col("device").alias("route")).agg(F.array_sort(F.collect_list(F.struct("t_ms", "lon", "lat"))).alias("p"))
    r = r.repartition(2 * spark.sparkContext.defaultParallelism, "route")  # few rows, much work each
    return handoff.parts(r.select("route", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords")))


PLANS = {
    "formatting": (formats, FORMATS),
    "names_and_codecs": (names, NAMES),
    "render_scalars": (render_scalars, RENDER_SCALARS),
    "quantile_report": (quantile_report, QUANTILES),
    "polygon_shapes": (shapes, SHAPES),
    "path_totals": (path_report, PATHS),
    "live_fix_filter": (live_filter, LIVE_FILTER),
    "posted_batches": (posted, POSTED),
    "pulled_page": (pulled, PULLED),
    "gpx_round_trip": (gpx_round_trip, GPX_ROUND_TRIP),
    "timeline_records": (timeline_records, TIMELINE_RECORDS),
    "fog_tiles": (fog_tiles, FOG_TILES),
    "handoff_parts": (handoff_parts, None),
}
