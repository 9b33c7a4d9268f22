"""Queries of the tile, pack and cache operators over the adapter view, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import FIXES_SQL, fixes
from ..functions import geo
from ..operators import tiles

#: Tiles that an extract emits: an extract is a device's group; tiles are coarse positions around one corner of the grid.
EXTRACTS_SQL = f"""SELECT 'region-' || (device % 9) AS extract, 1190 + device % 40 + fix_id % 3 AS tx, 1500 + device % 25 + fix_id % 2 AS ty,
  CAST(sum(acc) AS BIGINT) AS bytes FROM ({FIXES_SQL}) GROUP BY 1, 2, 3"""
N = 4096


def extracts(spark, d):
    f = fixes(spark, d)
    return f.groupBy(F.concat(F.lit("region-"), (F.col("device") % 9).cast("string")).alias("extract"), (1190 + F.col("device") % 40 + F.col("fix_id") % 3).alias("tx"), (1500 + F.col("device") % 25 + F.col("fix_id") % 2).alias("ty")).agg(F.sum("acc").alias("bytes"))


def border(spark, d):
    rebuild, ways, feeding = tiles.border_plan(extracts(spark, d).where("tx % 3 = 0").withColumn("tx", F.col("tx").cast("int")).withColumn("ty", F.col("ty").cast("int")))
    r = rebuild.groupBy("cell").agg(F.count("*").alias("rebuild"), F.sum("tx").alias("sum_tx"))
    w = ways.groupBy("cell").agg(F.count("*").alias("way_tiles"), F.sum("ty").alias("sum_ty"))
    e = feeding.groupBy("cell").agg(F.array_join(F.array_sort(F.collect_list("extract")), ",").alias("extracts"))
    return r.join(w, "cell").join(e, "cell", "left")


_RING = lambda src, r, keep: f"SELECT DISTINCT {keep} tx + x AS tx, ty + y AS ty FROM {src}, (SELECT unnest(range({-r}, {r + 1})) AS x), (SELECT unnest(range({-r}, {r + 1})) AS y)"
BORDER = f"""WITH e AS ({EXTRACTS_SQL}), s AS (SELECT * FROM e WHERE tx % 3 = 0), b AS (SELECT tx, ty FROM s GROUP BY tx, ty HAVING count(*) >= 2),
r0 AS ({_RING("b", 1, "")}), r AS (SELECT '6/' || (tx >> 6) || '/' || (ty >> 6) AS cell, tx, ty FROM r0),
w AS ({_RING("r", 2, "cell,")}), f AS (SELECT DISTINCT w.cell, s.extract FROM w JOIN s ON s.tx = w.tx AND s.ty = w.ty),
ra AS (SELECT cell, count(*) AS rebuild, CAST(sum(tx) AS BIGINT) AS sum_tx FROM r GROUP BY cell),
wa AS (SELECT cell, count(*) AS way_tiles, CAST(sum(ty) AS BIGINT) AS sum_ty FROM w GROUP BY cell),
fa AS (SELECT cell, string_agg(extract, ',' ORDER BY extract) AS extracts FROM f GROUP BY cell)
SELECT ra.cell, rebuild, sum_tx, way_tiles, sum_ty, extracts FROM ra JOIN wa ON wa.cell = ra.cell LEFT JOIN fa ON fa.cell = ra.cell"""


def region_grid(spark, d):
    return tiles.dominance(extracts(spark, d)).select("cell", "gx", "gy", "region")


_DOM = f"""e AS ({EXTRACTS_SQL}), c AS (SELECT extract, '6/' || (tx >> 6) || '/' || (ty >> 6) AS cell, tx >> 2 AS gx, ty >> 2 AS gy, CASE WHEN bytes > 0 THEN bytes ELSE 1 END AS weight FROM e),
sh AS (SELECT cell FROM c GROUP BY cell HAVING count(DISTINCT extract) > 1), g AS (SELECT cell, gx, gy, extract, sum(weight) AS weight FROM c WHERE cell IN (SELECT cell FROM sh) GROUP BY ALL),
dom AS (SELECT cell, gx, gy, extract AS region FROM g QUALIFY row_number() OVER (PARTITION BY cell, gx, gy ORDER BY weight DESC, extract) = 1)"""
REGION_GRID = f"WITH {_DOM} SELECT * FROM dom"


def cached_tiles(spark, d):
    f = fixes(spark, d)
    return f.groupBy((1190 + F.col("device") % 40).alias("tx"), (1500 + F.col("fix_id") % 30).alias("ty")).agg(F.sum("acc").alias("size"), F.max("t_ms").alias("last_used")).withColumn("cell", geo.pack_key(F.shiftright("tx", 6), F.shiftright("ty", 6)))


_CACHE = f"""k AS (SELECT 1190 + device % 40 AS tx, 1500 + fix_id % 30 AS ty, CAST(sum(acc) AS BIGINT) AS size, max(t_ms) AS last_used FROM ({FIXES_SQL}) GROUP BY 1, 2),
cache AS (SELECT *, '6/' || (tx >> 6) || '/' || (ty >> 6) AS cell FROM k)"""


def region_vote(spark, d):
    sub = cached_tiles(spark, d).groupBy("cell", F.shiftright("tx", 2).alias("gx"), F.shiftright("ty", 2).alias("gy")).agg(F.count("*").alias("tiles"), F.max("last_used").alias("last_used"))
    return tiles.region_votes(sub, tiles.dominance(extracts(spark, d))).select("cell", "region", "tiles", "last_used")


REGION_VOTE = f"""WITH {_DOM}, {_CACHE}, s AS (SELECT cell, tx >> 2 AS gx, ty >> 2 AS gy, count(*) AS tiles, max(last_used) AS last_used FROM cache GROUP BY ALL),
v AS (SELECT s.cell, dom.region, CAST(sum(s.tiles) AS BIGINT) AS tiles, max(s.last_used) AS last_used FROM s JOIN dom ON dom.cell = s.cell AND dom.gx = s.gx AND dom.gy = s.gy GROUP BY ALL)
SELECT cell, region, tiles, last_used FROM v QUALIFY row_number() OVER (PARTITION BY cell ORDER BY tiles DESC, last_used DESC, region) = 1"""


def box_pick(spark, d):
    f = fixes(spark, d)
    boxes = f.groupBy((F.col("device") % 12).alias("r")).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")).withColumn("region", F.concat(F.lit("r"), F.col("r").cast("string")))
    out = tiles.deepest_box(f.select("fix_id", "lon", "lat"), boxes.select("region", "west", "south", "east", "north"), "fix_id")
    return out.select("fix_id", "region", (F.floor(F.col("margin") * 1e6 + 0.5) / 1e6).alias("margin"))


BOX_PICK = f"""WITH f AS ({FIXES_SQL}), b AS (SELECT 'r' || (device % 12) AS region, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM f GROUP BY 1),
m AS (SELECT fix_id, region, least(lon - west, east - lon, lat - south, north - lat) AS margin FROM f JOIN b ON lon BETWEEN west AND east AND lat BETWEEN south AND north)
SELECT fix_id, region, floor(margin * 1e6 + 0.5) / 1e6 AS margin FROM m WHERE margin >= 0 QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY margin DESC, region) = 1"""


def eviction(spark, d):
    cache = cached_tiles(spark, d).withColumn("key", F.concat_ws("/", F.col("tx").cast("string"), F.col("ty").cast("string"))).withColumn("protect", F.col("tx") % 11 == 0)
    return tiles.evictions(cache, 6000, ["cell"]).select("cell", "key", "size")


EVICTION = f"""WITH {_CACHE}, p AS (SELECT *, tx || '/' || ty AS key, tx % 11 = 0 AS protect FROM cache),
q AS (SELECT *, sum(size) OVER (PARTITION BY cell) - coalesce(sum(CASE WHEN protect THEN 0 ELSE size END) OVER (PARTITION BY cell ORDER BY protect, last_used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p)
SELECT cell, key, size FROM q WHERE NOT protect AND rest > 6000"""


def status(spark, d):
    out = tiles.cache_status(cached_tiles(spark, d))
    return out.select(F.coalesce("cell", F.lit("all")).alias("cell"), F.coalesce("sx", F.lit(-1)).cast("long").alias("sx"), F.coalesce("sy", F.lit(-1)).cast("long").alias("sy"), "tiles", "bytes", "last_used")


STATUS = f"""WITH {_CACHE}, s AS (SELECT *, tx >> 2 AS sx, ty >> 2 AS sy FROM cache)
SELECT coalesce(cell, 'all') AS cell, coalesce(sx, -1) AS sx, coalesce(sy, -1) AS sy, count(*) AS tiles, CAST(sum(size) AS BIGINT) AS bytes, max(last_used) AS last_used
FROM s GROUP BY GROUPING SETS ((s.cell), (s.cell, s.sx, s.sy), ())"""


def index_diff(spark, d):
    c = cached_tiles(spark, d).withColumn("cell", F.concat_ws("/", F.lit("6"), F.col("tx").cast("string"), F.col("ty").cast("string")))
    before = c.where("size % 7 <> 0").select("cell", F.md5(F.col("size").cast("string")).alias("sha256"), (F.col("last_used") % 1000).alias("built_at"))
    after = c.where("size % 5 <> 0").select("cell", F.md5((F.col("size") + F.when(F.col("size") % 3 == 0, 1).otherwise(0)).cast("string")).alias("sha256"), (F.col("last_used") % 1000).alias("built_at"))
    return tiles.index_changes(before, after)


INDEX_DIFF = f"""WITH {_CACHE}, c AS (SELECT '6/' || tx || '/' || ty AS cell, size, last_used % 1000 AS t FROM cache),
a AS (SELECT cell, md5(CAST(size AS VARCHAR)) AS h, t FROM c WHERE size % 7 <> 0), b AS (SELECT cell, md5(CAST(size + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS h, t FROM c WHERE size % 5 <> 0)
SELECT coalesce(a.cell, b.cell) AS cell, CASE WHEN a.cell IS NULL THEN 'added' WHEN b.cell IS NULL THEN 'dropped' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.cell = b.cell WHERE a.cell IS NULL OR b.cell IS NULL OR a.h IS DISTINCT FROM b.h OR a.t IS DISTINCT FROM b.t"""


def pack_groups(spark, d):
    rows = fixes(spark, d).select(F.col("fix_id").alias("seq"), (1190 + F.col("device") % 40).alias("tx"), (1500 + F.col("fix_id") % 30).alias("ty"), F.concat(F.lit("x"), (F.col("device") % 4).cast("string")).alias("origin"), F.repeat(F.lit("ab"), (F.col("acc") + 1).cast("int")).alias("content"))
    out = tiles.packs(rows.withColumn("tx", F.col("tx").cast("int")).withColumn("ty", F.col("ty").cast("int")))
    return out.select("cell", "tiles", "bytes", "sha256", F.array_join("origins", ",").alias("origins"))


_MORTON = " + ".join(f"((tx >> {b}) & 1) * {4**b} + ((ty >> {b}) & 1) * {2 * 4**b}" for b in range(16))
PACK_GROUPS = f"""WITH r AS (SELECT fix_id AS seq, 1190 + device % 40 AS tx, 1500 + fix_id % 30 AS ty, 'x' || (device % 4) AS origin, repeat('ab', CAST(acc + 1 AS BIGINT)) AS content FROM ({FIXES_SQL})),
c AS (SELECT *, '6/' || (tx >> 6) || '/' || (ty >> 6) AS cell FROM r), o AS (SELECT cell, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM c GROUP BY cell),
l AS (SELECT *, {_MORTON} AS morton FROM c QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY seq DESC) = 1),
p AS (SELECT cell, count(*) AS tiles, CAST(sum(length(content)) AS BIGINT) AS bytes, sha256(string_agg(sha256(content), '' ORDER BY morton)) AS sha256 FROM l GROUP BY cell)
SELECT p.*, o.origins FROM p JOIN o ON o.cell = p.cell"""


def coverage(spark, d):
    e = extracts(spark, d)
    wanted = cached_tiles(spark, d).select((F.col("tx") % 5).alias("area"), "tx", "ty")
    one = e.where("tx % 4 = 0").groupBy("tx", "ty").agg(F.min("extract").alias("region"))
    return tiles.coverage(wanted, one, e.where("ty % 5 = 0"), e.where("(tx + ty) % 6 = 0"), e.where("tx < 1216").select(geo.pack_key(F.shiftright("tx", 6), F.shiftright("ty", 6)).alias("cell")), ["area"])


COVERAGE = f"""WITH e AS ({EXTRACTS_SQL}), {_CACHE}, pre AS (SELECT tx, ty, min(extract) AS region FROM e WHERE tx % 4 = 0 GROUP BY tx, ty),
dn AS (SELECT DISTINCT tx, ty FROM e WHERE ty % 5 = 0 OR (tx + ty) % 6 = 0), pk AS (SELECT DISTINCT '6/' || (tx >> 6) || '/' || (ty >> 6) AS cell FROM e WHERE tx < 1216),
j AS (SELECT k.tx % 5 AS area, pre.region, pre.region IS NOT NULL OR dn.tx IS NOT NULL AS there, pk.cell IS NOT NULL AS packed FROM cache k LEFT JOIN pre ON pre.tx = k.tx AND pre.ty = k.ty LEFT JOIN dn ON dn.tx = k.tx AND dn.ty = k.ty LEFT JOIN pk ON pk.cell = k.cell)
SELECT area, count(*) AS needed, count(*) FILTER (there) AS available, count(*) FILTER (NOT there AND packed) AS packable, coalesce(string_agg(DISTINCT region, ',' ORDER BY region), '') AS regions FROM j GROUP BY area"""


def overlay(spark, d):
    t = fixes(spark, d).select(F.shiftright(geo.cell_x("lon"), 8).alias("tx"), F.shiftright(geo.cell_y("lat"), 8).alias("ty"))
    return tiles.overlay_tiles(t).groupBy("z").agg(F.count("*").alias("tiles"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")).withColumn("z", F.col("z").cast("long"))


def _overlay_sql():
    from .explore import cell, wx, wy

    return f"""WITH f AS ({FIXES_SQL}), t AS (SELECT DISTINCT {cell(wx("lon"))} >> 8 AS tx, {cell(wy("lat"))} >> 8 AS ty FROM f), z AS (SELECT *, unnest(range(2, 19)) AS z FROM t),
x AS (SELECT *, unnest(range(greatest(0, tx * 256 - 32) >> (22 - z), (least(4194303, tx * 256 + 287) >> (22 - z)) + 1)) AS x FROM z),
y AS (SELECT DISTINCT z, x, unnest(range(greatest(0, ty * 256 - 32) >> (22 - z), (least(4194303, ty * 256 + 287) >> (22 - z)) + 1)) AS y FROM x)
SELECT z, count(*) AS tiles, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM y GROUP BY z"""


def prefetch_ring(spark, d):
    c = fixes(spark, d).select((F.col("device") % 40).alias("x"), (4095 - F.col("device") % 25).alias("y")).distinct()
    return tiles.ring_order(c, 2).select("x", "y", F.col("place").cast("long").alias("place"), "tx", "ty", F.col("d").cast("long").alias("d"))


PREFETCH_RING = f"""WITH c AS (SELECT DISTINCT device % 40 AS x, 4095 - device % 25 AS y FROM ({FIXES_SQL})),
o AS (SELECT x, y, x + dx AS tx, y + dy AS ty, greatest(abs(dx), abs(dy)) AS d, dx, dy FROM c, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy))
SELECT x, y, row_number() OVER (PARTITION BY x, y ORDER BY d, dy, dx) AS place, tx, ty, d FROM o WHERE tx BETWEEN 0 AND 4095 AND ty BETWEEN 0 AND 4095"""


def tile_lookup(spark, d):
    """Where each wanted tile is found first: memory, prebuilt, downloaded, then the fallback."""
    e = extracts(spark, d)
    src = [e.where(f"(tx * 7 + ty) % 5 = {k}").select("tx", "ty", F.lit(k).alias("rank"), F.lit(name).alias("found")) for k, name in enumerate(("memory", "prebuilt", "downloaded", "fallback"))]
    more = e.where("ty % 2 = 0").select("tx", "ty", F.lit(3).alias("rank"), F.lit("fallback").alias("found"))
    rows = src[0].unionByName(src[1]).unionByName(src[2]).unionByName(src[3]).unionByName(more)
    return tiles.first_of(rows, ["tx", "ty"], ["rank"]).groupBy("found").agg(F.count("*").alias("tiles"), F.sum("tx").alias("sum_tx"))


TILE_LOOKUP = f"""WITH e AS ({EXTRACTS_SQL}), r AS (SELECT tx, ty, (tx * 7 + ty) % 5 AS rank FROM e WHERE (tx * 7 + ty) % 5 < 4 UNION ALL SELECT tx, ty, 3 FROM e WHERE ty % 2 = 0),
m AS (SELECT tx, ty, min(rank) AS rank FROM r GROUP BY tx, ty) SELECT ['memory', 'prebuilt', 'downloaded', 'fallback'][rank + 1] AS found, count(*) AS tiles, CAST(sum(tx) AS BIGINT) AS sum_tx FROM m GROUP BY 1"""


def way_union(spark, d):
    """Ways of several extracts: the first extract's copy of an id stays."""
    rows = fixes(spark, d).select((F.col("fix_id") % 997).alias("way_id"), (F.col("device") % 9).alias("extract"), "fix_id", "acc")
    return tiles.first_of(rows, ["way_id"], ["extract", "fix_id"]).select("way_id", "extract", "acc")


WAY_UNION = f"SELECT fix_id % 997 AS way_id, device % 9 AS extract, acc FROM ({FIXES_SQL}) QUALIFY row_number() OVER (PARTITION BY fix_id % 997 ORDER BY device % 9, fix_id) = 1"


def ranges(spark, d):
    rows = fixes(spark, d).select((F.col("device") % 20).alias("pack"), (F.col("fix_id") * 20011).alias("offset"), (F.col("acc") * 190 + 100).alias("length"))
    return tiles.byte_ranges(rows, ["pack"])


RANGES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT device % 20 AS pack, fix_id * 20011 AS o, acc * 190 + 100 AS n, row_number() OVER (PARTITION BY device % 20 ORDER BY fix_id) AS k FROM ({FIXES_SQL})),
w AS (SELECT pack, k, o AS start, o + n AS stop, 1 AS run FROM e WHERE k = 1 UNION ALL
  SELECT e.pack, e.k, CASE WHEN e.o - w.stop <= 32768 AND e.o + e.n - w.start <= 4194304 THEN w.start ELSE e.o END,
    CASE WHEN e.o - w.stop <= 32768 AND e.o + e.n - w.start <= 4194304 THEN greatest(w.stop, e.o + e.n) ELSE e.o + e.n END,
    CASE WHEN e.o - w.stop <= 32768 AND e.o + e.n - w.start <= 4194304 THEN w.run ELSE w.run + 1 END FROM w JOIN e ON e.pack = w.pack AND e.k = w.k + 1)
SELECT pack, start, max(stop) AS stop, count(*) AS entries FROM w GROUP BY pack, run, start"""


PLANS = {
    "border_plan": (border, BORDER),
    "region_dominance": (region_grid, REGION_GRID),
    "region_vote": (region_vote, REGION_VOTE),
    "region_by_box": (box_pick, BOX_PICK),
    "cache_eviction": (eviction, EVICTION),
    "cache_status": (status, STATUS),
    "pack_index_diff": (index_diff, INDEX_DIFF),
    "pack_groups": (pack_groups, PACK_GROUPS),
    "coverage_report": (coverage, COVERAGE),
    "overlay_tiles": (overlay, _overlay_sql()),
    "prefetch_ring": (prefetch_ring, PREFETCH_RING),
    "tile_lookup": (tile_lookup, TILE_LOOKUP),
    "way_union": (way_union, WAY_UNION),
    "byte_ranges": (ranges, RANGES),
}
