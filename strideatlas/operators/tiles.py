"""Set operators over tiles, packs, caches and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def ring(tiles: DataFrame, radius: int, keep: tuple = (), zoom: int = geo.GRAPH_ZOOM) -> DataFrame:
    """Chebyshev dilation of (keep..., tx, ty), clamped to the zoom's grid."""
    n, span = 1 << zoom, F.sequence(F.lit(-radius), F.lit(radius))
    out = tiles.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    out = out.select(*keep, (F.col("tx") + F.col("dx")).alias("tx"), (F.col("ty") + F.col("dy")).alias("ty"))
    return out.where(F.col("tx").between(0, n - 1) & F.col("ty").between(0, n - 1)).distinct()


def ring_order(centres: DataFrame, radius: int, zoom: int = geo.GRAPH_ZOOM) -> DataFrame:
    """(…, x, y) -> tiles of the ring with their place: centre first, then by distance, rows, columns."""
    n, span = 1 << zoom, F.sequence(F.lit(-radius), F.lit(radius))
    out = centres.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumn("d", F.greatest(F.abs("dx"), F.abs("dy")))
    out = out.withColumn("tx", F.col("x") + F.col("dx")).withColumn("ty", F.col("y") + F.col("dy"))
    w = Window.partitionBy("x", "y").orderBy("d", "dy", "dx")
    return out.where(F.col("tx").between(0, n - 1) & F.col("ty").between(0, n - 1)).withColumn("place", F.row_number().over(w)).drop("dx", "dy")


def tiles_of_box(boxes: DataFrame, zoom: int = geo.GRAPH_ZOOM) -> DataFrame:
    """Boxes (…, west, south, east, north) -> the tiles that they overlap."""
    out = boxes.withColumn("tx", F.explode(F.sequence(geo.graph_tile_x("west", zoom), geo.graph_tile_x("east", zoom))))
    return out.withColumn("ty", F.explode(F.sequence(geo.graph_tile_y("north", zoom), geo.graph_tile_y("south", zoom))))


def border_tiles(extracts: DataFrame) -> DataFrame:
    """Tiles that two extracts or more emit: (extract, tx, ty) -> (tx, ty)."""
    return extracts.groupBy("tx", "ty").agg(F.count("*").alias("n")).where("n >= 2").select("tx", "ty")


def border_plan(extracts: DataFrame, ring_rebuild: int = 1, ring_ways: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cell, tx, ty) to rebuild, (cell, tx, ty) whose ways feed them, (cell, extract) that may hold such ways."""
    cell = geo.pack_key(geo.pack_cell("tx"), geo.pack_cell("ty"))
    rebuild = ring(border_tiles(extracts), ring_rebuild).withColumn("cell", cell).select("cell", "tx", "ty")
    ways = ring(rebuild, ring_ways, keep=("cell",))
    feeding = ways.join(extracts, ["tx", "ty"]).select("cell", "extract").distinct()
    return rebuild, ways, feeding


def ways_of_cells(nodes_of_ways: DataFrame, way_tiles: DataFrame) -> DataFrame:
    """(way_id, lon, lat) of every node, (cell, tx, ty) -> distinct (cell, way_id) that touch the cell's tiles."""
    at = nodes_of_ways.select("way_id", geo.graph_tile_x("lon").alias("tx"), geo.graph_tile_y("lat").alias("ty")).distinct()
    return at.join(way_tiles, ["tx", "ty"]).select("cell", "way_id").distinct()


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key: unions where the first id wins, lookups by priority, overrides where the last wins."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def dominance(extracts: DataFrame, grid_zoom: int = 10) -> DataFrame:
    """(extract, tx, ty, bytes) -> cell, gx, gy, region: the extract with most bytes there (ties: alphabetical), in cells
    that two extracts or more share."""
    shift = geo.GRAPH_ZOOM - grid_zoom
    rows = extracts.select("extract", geo.pack_key(geo.pack_cell("tx"), geo.pack_cell("ty")).alias("cell"), F.shiftright("tx", shift).alias("gx"), F.shiftright("ty", shift).alias("gy"), F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(1).alias("weight"))
    shared = rows.groupBy("cell").agg(F.min("extract").alias("a"), F.max("extract").alias("b")).where("a <> b").select("cell")
    sums = rows.join(shared, "cell", "left_semi").groupBy("cell", "gx", "gy", "extract").agg(F.sum("weight").alias("weight"))
    return first_of(sums, ["cell", "gx", "gy"], [F.desc("weight"), "extract"]).select("cell", "gx", "gy", F.col("extract").alias("region"))


def region_votes(cached: DataFrame, regions: DataFrame) -> DataFrame:
    """cached (cell, gx, gy, tiles, last_used), regions from dominance() -> the region of each cell: most tiles, then latest
    use, then alphabetical."""
    votes = cached.join(regions, ["cell", "gx", "gy"]).groupBy("cell", "region").agg(F.sum("tiles").alias("tiles"), F.max("last_used").alias("last_used"))
    return first_of(votes, ["cell"], [F.desc("tiles"), F.desc("last_used"), "region"])


def deepest_box(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """points (key, lon, lat), boxes (region, west, south, east, north) -> the region whose box holds the point deepest
    inside (ties: alphabetical). Boxes are put on whole-degree cells, so it is an equi-join."""
    spread = boxes.withColumn("gx", F.explode(F.sequence(F.floor("west").cast("int"), F.floor("east").cast("int")))).withColumn("gy", F.explode(F.sequence(F.floor("south").cast("int"), F.floor("north").cast("int"))))
    at = points.withColumn("gx", F.floor("lon").cast("int")).withColumn("gy", F.floor("lat").cast("int"))
    margin = F.least(F.col("lon") - F.col("west"), F.col("east") - F.col("lon"), F.col("lat") - F.col("south"), F.col("north") - F.col("lat"))
    out = at.join(spread, ["gx", "gy"]).withColumn("margin", margin).where("margin >= 0")
    return first_of(out, [key], [F.desc("margin"), "region"]).select(key, "region", "margin")


def evictions(cache: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """Unprotected rows to evict, longest unused first, until the cache fits: (by..., key, size, last_used, protect)."""
    total = F.sum("size").over(Window.partitionBy(*by))
    before = F.sum(F.when(~F.col("protect"), F.col("size")).otherwise(0)).over(Window.partitionBy(*by).orderBy(F.col("protect"), "last_used", "key").rowsBetween(Window.unboundedPreceding, -1))
    rows = cache.withColumn("left", total - F.coalesce(before, F.lit(0)))
    return rows.where(~F.col("protect") & (F.col("left") > budget)).drop("left")


def cache_status(cache: DataFrame) -> DataFrame:
    """Tiles, bytes and latest use by cell, by z10 sub-cell and in all, in one pass."""
    rows = cache.withColumn("sx", F.shiftright("tx", 2)).withColumn("sy", F.shiftright("ty", 2))
    sets = [["cell"], ["cell", "sx", "sy"], []]
    out = rows.groupingSets(sets, "cell", "sx", "sy").agg(F.count("*").alias("tiles"), F.sum("size").alias("bytes"), F.max("last_used").alias("last_used"))
    return out


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells of two pack indexes (cell, sha256, built_at): added, dropped or changed."""
    a = before.select("cell", F.col("sha256").alias("old_sha"), F.col("built_at").alias("old_at"), F.lit(True).alias("was"))
    b = after.select("cell", F.col("sha256").alias("new_sha"), F.col("built_at").alias("new_at"), F.lit(True).alias("is"))
    both = a.join(b, "cell", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "dropped").when(~(F.col("old_sha").eqNullSafe(F.col("new_sha")) & F.col("old_at").eqNullSafe(F.col("new_at"))), "changed")
    return both.withColumn("change", kind).where("change IS NOT NULL").select("cell", "change")


def packs(tiles: DataFrame) -> DataFrame:
    """tiles (seq, tx, ty, origin, content): the last of a tile wins -> a row for each pack with its size, tiles, the hash of
    its tiles in Morton order and all origins, winning or not."""
    rows = tiles.withColumn("cell", geo.pack_key(geo.pack_cell("tx"), geo.pack_cell("ty")))
    origins = rows.groupBy("cell").agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    last = first_of(rows, ["tx", "ty"], [F.desc("seq")]).withColumn("morton", geo.morton_key("tx", "ty"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("morton", F.sha2("content", 256).alias("h")))), lambda x: x["h"]), "")
    made = last.groupBy("cell").agg(F.count("*").alias("tiles"), F.sum(F.length("content")).alias("bytes"), F.sha2(digests, 256).alias("sha256"))
    return made.join(origins, "cell")


def coverage(wanted: DataFrame, prebuilt: DataFrame, downloaded: DataFrame, cached: DataFrame, packed_cells: DataFrame, by: list[str]) -> DataFrame:
    """What is there of wanted tiles (by..., tx, ty): needed, available, packable, regions."""
    mark = lambda df, name: df.select("tx", "ty").distinct().withColumn(name, F.lit(True))
    rows = wanted.join(prebuilt.select("tx", "ty", "region"), ["tx", "ty"], "left").join(mark(downloaded, "down"), ["tx", "ty"], "left").join(mark(cached, "kept"), ["tx", "ty"], "left")
    rows = rows.withColumn("cell", geo.pack_key(geo.pack_cell("tx"), geo.pack_cell("ty"))).join(packed_cells.select("cell").distinct().withColumn("packed", F.lit(True)), "cell", "left")
    there = F.col("region").isNotNull() | F.col("down").isNotNull() | F.col("kept").isNotNull()
    return rows.groupBy(*by).agg(F.count("*").alias("needed"), F.count_if(there).alias("available"), F.count_if(~there & F.col("packed").isNotNull()).alias("packable"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


def overlay_tiles(touched: DataFrame, min_zoom: int = 2, max_zoom: int = 18, margin: int = 32) -> DataFrame:
    """z14 tiles (tx, ty) -> (z, x, y) of every rendered tile whose ground, with a margin of cells, overlaps one of them."""
    last = geo.WORLD - 1
    low = lambda c: F.greatest(F.lit(0), F.col(c) * geo.TILE_SIZE - margin)
    high = lambda c: F.least(F.lit(last), (F.col(c) + 1) * geo.TILE_SIZE - 1 + margin)
    rows = touched.select("tx", "ty").distinct().withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    scale = F.pow(F.lit(2.0), F.lit(geo.CELL_ZOOM) - F.col("z"))
    down = lambda c: F.floor(c / scale).cast("int")
    rows = rows.withColumn("x", F.explode(F.sequence(down(low("tx")), down(high("tx"))))).withColumn("y", F.explode(F.sequence(down(low("ty")), down(high("ty")))))
    return rows.select("z", "x", "y").distinct()


def byte_ranges(entries: DataFrame, by: list[str], max_gap: int = 32 * 1024, max_run: int = 4 * 1024 * 1024) -> DataFrame:
    """Requests that cover wanted entries (by..., offset, length): neighbours share one while the gap and the run stay small.
    The run's cap depends on where the run began, so each pack's entries are walked in order."""
    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in by)

    def walk(pdf):
        import pandas as pd

        out = []
        for offset, length in pdf.sort_values(["offset", "length"])[["offset", "length"]].itertuples(index=False):
            end = offset + length
            if out and offset - out[-1][1] <= max_gap and end - out[-1][0] <= max_run:
                out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + 1
            else:
                out.append([offset, end, 1])
        made = pd.DataFrame(out, columns=["start", "stop", "entries"])
        for c in reversed(by):
            made.insert(0, c, pdf[c].iloc[0])
        return made

    return entries.groupBy(*by).applyInPandas(walk, f"{kinds}, start long, stop long, entries long")


def shard_plan(packs: list[tuple[str, int]], shards: dict[str, list[str]], cap_bytes: int) -> dict:
    """Stable first-fit: cells stay where they are; new ones, largest first, go where most room is left. Hundreds of packs,
    so it runs on the driver: packs (cell, bytes), shards name -> cells -> {'cells', 'added', 'dropped', 'unassigned'}."""
    size = dict(packs)
    number = lambda cell: ([int(x) for x in cell.split("/")], cell)
    placed: dict[str, str] = {}
    cells: dict[str, list[str]] = {name: [] for name in shards}
    dropped = []
    for name, own in shards.items():
        for cell in own:
            if cell not in size:
                dropped.append(cell)
            elif cell not in placed:
                placed[cell] = name
                cells[name].append(cell)
    room = {name: cap_bytes - sum(size[c] for c in own) for name, own in cells.items()}
    added, unassigned = [], []
    for cell in sorted((c for c in size if c not in placed), key=lambda c: (-size[c], number(c))):
        fitting = [name for name in room if room[name] >= size[cell]]
        if not fitting:
            unassigned.append(cell)
            continue
        best = max(fitting, key=lambda name: room[name])  # the first of equals
        cells[best].append(cell)
        room[best] -= size[cell]
        added.append(cell)
    return {"cells": {k: sorted(v, key=number) for k, v in cells.items()}, "added": added, "dropped": sorted(dropped, key=number), "unassigned": unassigned}
