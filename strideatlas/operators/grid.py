"""Visit counts: the ordered write algebra, statistics and the pyramid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

MOST = 255


def merged_counts(ops: DataFrame, key: list[str]) -> DataFrame:
    """Counts after an ordered log: ops (key..., seq, kind 'max' with v, or 'track' which adds one).

    Every op is x -> max(x + a, b), and those compose, so no sequential fold is needed: the result is the larger of all
    increments and, over the masks, of the mask's value and the increments after it; saturation can wait until the end."""
    later = Window.partitionBy(*key).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inc = F.when(F.col("kind") == "track", 1).otherwise(0)
    rows = ops.withColumn("inc", inc).withColumn("after", F.coalesce(F.sum("inc").over(later), F.lit(0)))
    masked = F.max(F.when(F.col("kind") == "max", F.col("v") + F.col("after")))
    return rows.groupBy(*key).agg(F.least(F.lit(MOST), F.greatest(F.sum("inc"), F.coalesce(masked, F.lit(0)))).cast("int").alias("count"))


def track_cells(samples: DataFrame, track: list[str]) -> DataFrame:
    """Each cell once for each track."""
    return samples.select(*track, "cx", "cy").distinct()


def visits(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a log of tracks only: one for each track, saturating."""
    return cells.groupBy(*by, "cx", "cy").agg(F.least(F.lit(MOST), F.count("*")).cast("int").alias("count"))


def statistics(counts: DataFrame, by: list[str]) -> DataFrame:
    tile = F.struct(F.shiftright("cx", geo.TILE_SHIFT), F.shiftright("cy", geo.TILE_SHIFT))
    return counts.groupBy(*by).agg(F.count("*").alias("visited_cells"), F.sum("count").cast("long").alias("visits"), F.sum(geo.cell_area_m2("cy")).alias("area_m2"), F.countDistinct(tile).alias("tiles"))


def pyramid(counts: DataFrame, levels: tuple = geo.LEVELS) -> DataFrame:
    """level, cx, cy, count: max pooling; each level is made from the one below it, so a level's shuffle carries what the
    level below has left."""
    out, finer, at = None, counts.select("cx", "cy", "count"), geo.TILE_ZOOM
    for level in sorted(levels, reverse=True):
        k = at - level
        if k:
            finer = finer.groupBy(F.shiftright("cx", k).alias("cx"), F.shiftright("cy", k).alias("cy")).agg(F.max("count").alias("count"))
            at = level
        row = finer.select(F.lit(level).alias("level"), "cx", "cy", "count")
        out = row if out is None else out.unionByName(row)
    return out


def fresh_cells(versions: DataFrame) -> DataFrame:
    """Cells of each version of a track that the version before it did not touch: (track, version, cx, cy)."""
    before = versions.select("track", (F.col("version") + 1).alias("version"), "cx", "cy")
    return versions.join(before, ["track", "version", "cx", "cy"], "left_anti")


def dilated(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells and their neighbours, each once."""
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)])
    return cells.withColumn("o", F.explode(around)).select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).distinct()


def novelty(samples: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """Share of samples whose cell and neighbours were never visited. Visited cells are dilated once, then it is an
    equi-join; samples of one cell are counted before the join."""
    counted = samples.groupBy(*by, "cx", "cy").agg(F.count("*").alias("n"))
    known = dilated(seen).withColumn("known", F.lit(1))
    out = counted.join(known, ["cx", "cy"], "left")
    return out.groupBy(*by).agg(F.sum("n").alias("samples"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unseen"))


def fold_imports(imports: DataFrame, within_ms: int = 10 * 60_000) -> DataFrame:
    """Chunks of one import (source, file_name) that follow within ten minutes of their record's first are one record:
    items add up, the last note stays. imports (seq, at_ms, source, file_name, items, note); a chunk's note starts 'part '.

    Whether a record starts depends on where the one before it did, so a log is read in order, row by row; a task holds one
    open record, whatever a log's length."""
    ordered = imports.select("seq", "at_ms", "source", "file_name", "items", "note").repartition("source", "file_name").sortWithinPartitions("source", "file_name", "seq", "at_ms", "items", "note")

    def run(batches):
        log, open_ = None, None
        for batch in batches:
            out = []
            for _, at, source, name, items, note in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if log != (source, name):
                    out += [open_] if open_ else []
                    log, open_ = (source, name), None
                if open_ and (note or "").startswith("part ") and at - open_[3] < within_ms:
                    open_ = (*open_[:4], open_[4] + items, note)
                else:
                    out += [open_] if open_ else []
                    open_ = (source, name, open_[2] + 1 if open_ else 1, at, items, note)
            if out:
                yield records_of(out)
        if open_:
            yield records_of([open_])

    return ordered.mapInArrow(run, "source string, file_name string, record long, at_ms long, items long, note string")


def records_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["source", "file_name", "record", "at_ms", "items", "note"])


def lookup(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of asked cells, 0 where unknown."""
    return cells.join(counts, ["cx", "cy"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def tile_of(c: str) -> Column:
    return F.shiftright(c, geo.TILE_SHIFT)
