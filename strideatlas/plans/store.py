"""The grid as tables in a folder: an append-only write log, tracks and imports; counts are derived from the log.

Every mutation appends rows under a sequence number that no row has yet, and the row in ``versions`` comes last: only what
stands under a committed number is read, so a mutation that failed half-way has not happened. Nothing is rewritten; counts
come from the log's closed form. Deleting a track keeps its counts, as visits have happened. One writer at a time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid, raster, tracks
from ..operators import tiles as tile_ops

TABLES = {
    "log": "seq long, kind string, track_id string, cx int, cy int, v int",
    "tracks": "seq long, track_id string, source string, name string, points array<struct<lon:double,lat:double,t_ms:bigint>>, deleted boolean",
    "imports": "seq long, at_ms long, source string, file_name string, items long, note string",
    "versions": "seq long, at_ms long",
}


class GridStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name])
        try:
            return reader.parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        cast = [F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in TABLES[name].split(", ")]
        rows.select(*cast).write.mode("append").parquet(f"{self.path}/{name}")

    def committed(self, name: str) -> DataFrame:
        return self.table(name).join(self.table("versions").select("seq").distinct(), "seq", "left_semi")

    def version(self) -> int:
        """How many times the grid was changed; deleting a track changes no count."""
        return self.table("versions").where("at_ms IS NOT NULL").count()

    def next_seq(self) -> int:
        return 1 + max(self.table(t).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] for t in TABLES)

    def commit(self, seq: int, at_ms: int | None) -> None:
        self.append("versions", self.spark.createDataFrame([(seq, at_ms)], TABLES["versions"]))

    def log(self) -> DataFrame:
        """Ops since the last wipe."""
        rows = self.committed("log")
        wiped = rows.where("kind = 'wipe'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("wiped"))
        return rows.join(F.broadcast(wiped)).where("seq > wiped").drop("wiped")  # one row

    def counts(self) -> DataFrame:
        return grid.merged_counts(self.log().where("kind <> 'wipe'"), ["cx", "cy"]).where("count > 0")

    def statistics(self) -> dict:
        found = grid.statistics(self.counts().withColumn("all", F.lit(1)), ["all"]).first()
        zero = {"visited_cells": 0, "visits": 0, "area_m2": 0.0, "tiles": 0}
        return (zero if found is None else {k: found[k] for k in zero}) | {"version": self.version()}

    def latest_tracks(self) -> DataFrame:
        wiped = self.committed("log").where("kind = 'wipe'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("wiped"))
        last = self.committed("tracks").groupBy("track_id").agg(F.max_by(F.struct("seq", "source", "name", "points", "deleted"), "seq").alias("t"))
        return last.select("track_id", "t.*").join(F.broadcast(wiped)).where("NOT deleted AND seq > wiped").drop("wiped", "deleted")

    def cells_of(self, marked: DataFrame) -> DataFrame:
        points = marked.select("track_id", F.posexplode("points").alias("at", "p")).select("track_id", "at", "p.lon", "p.lat", "p.t_ms")
        steps = tracks.with_previous(points, ["track_id"], ["at"])
        return grid.track_cells(tracks.densify(steps, tracks.RASTER_STEP_M), ["track_id"])

    def apply(self, at_ms: int, new_tracks: DataFrame | None = None, masks: DataFrame | None = None, source: str = "import", file_name: str | None = None, note: str | None = None) -> dict:
        """An import: masks (cx, cy, v) first, then tracks (track_id, source, name, points), each cell once for each track and
        only where the track's stored version did not touch it."""
        seq, items = self.next_seq(), 0
        if masks is not None:
            self.append("log", masks.select(F.lit(seq).alias("seq"), F.lit("max").alias("kind"), F.lit(None).alias("track_id"), "cx", "cy", "v"))
        if new_tracks is not None:
            items = new_tracks.count()
            before = self.cells_of(self.latest_tracks().join(new_tracks.select("track_id"), "track_id", "left_semi"))
            fresh = self.cells_of(new_tracks).join(before, ["track_id", "cx", "cy"], "left_anti")
            self.append("log", fresh.select((F.lit(seq) * 1).alias("seq"), F.lit("track").alias("kind"), "track_id", "cx", "cy", F.lit(0).alias("v")))
            self.append("tracks", new_tracks.select(F.lit(seq).alias("seq"), "track_id", "source", "name", "points", F.lit(False).alias("deleted")))
        self.append("imports", self.spark.createDataFrame([(seq, at_ms, source, file_name, items, note)], TABLES["imports"]))
        self.commit(seq, at_ms)
        return self.statistics()

    def delete_track(self, track_id: str) -> dict:
        seq = self.next_seq()
        self.append("tracks", self.spark.createDataFrame([(seq, track_id, None, None, None, True)], TABLES["tracks"]))
        self.commit(seq, None)
        return self.statistics()

    def delete_all(self, at_ms: int) -> dict:
        seq = self.next_seq()
        self.append("log", self.spark.createDataFrame([(seq, "wipe", None, None, None, None)], TABLES["log"]))
        self.commit(seq, at_ms)
        return self.statistics()

    def list_tracks(self) -> DataFrame:
        points = self.latest_tracks().select("track_id", "source", "name", F.posexplode("points").alias("at", "p")).select("track_id", "source", "name", "at", "p.lon", "p.lat", "p.t_ms")
        return tracks.summaries(points, ["track_id", "source", "name"], ["at"]).orderBy(F.desc_nulls_last("start_ms"), "track_id")

    def imports(self) -> DataFrame:
        return grid.fold_imports(self.committed("imports"))

    def base_tiles(self) -> DataFrame:
        return self.counts().select(grid.tile_of("cx").alias("tx"), grid.tile_of("cy").alias("ty")).distinct()

    def render(self, asked: DataFrame, size: int = 256, look: raster.Look = raster.Look()) -> DataFrame:  # noqa: B008
        return raster.tiles(asked, grid.pyramid(self.counts()), size, look)


MOST_AREA_KM = 8.0


class Areas:
    """Downloaded areas as a table by area_id: an area's tiles are written, listed and deleted as one partition."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        schema = "tx int, ty int, bytes binary, at_ms long, area_id string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def store(self, area_id: str, lon: float, lat: float, radius_km: float, tiles: DataFrame, at_ms: int) -> DataFrame:
        """Keeps those of tiles (tx, ty, bytes) that the square around the centre touches; an area that is there is replaced."""
        if not 0 < radius_km <= MOST_AREA_KM:
            raise ValueError(f"an area has a radius of up to {MOST_AREA_KM} km")
        dy, dx = radius_km * 1000 / geo.KY, radius_km * 1000 / (geo.KX * math.cos(lat * geo.DEG))
        box = self.spark.createDataFrame([(lon - dx, lat - dy, lon + dx, lat + dy)], "west double, south double, east double, north double")
        wanted = tile_ops.tiles_of_box(box).select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"))
        own = tiles.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "bytes").join(F.broadcast(wanted), ["tx", "ty"])  # some hundred tiles
        own.withColumn("at_ms", F.lit(at_ms).cast("long")).withColumn("area_id", F.lit(area_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area_id").parquet(self.path)
        return self.list()

    def list(self) -> DataFrame:
        return self.table().groupBy("area_id").agg(F.count("*").alias("tiles"), F.sum(F.octet_length("bytes")).alias("bytes"), F.max("at_ms").alias("at_ms")).orderBy("area_id")

    def delete(self, area_id: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/area_id={area_id}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.spark.catalog.refreshByPath(self.path)
        return self.list()


def verified(files: DataFrame, sums: DataFrame) -> DataFrame:
    """files (file, content), sums (file, md5): verified true or false, null where no sum is known; a file that is missing is false."""
    got = files.select("file", F.md5("content").alias("got"))
    out = got.join(sums.select("file", F.lower("md5").alias("want")), "file", "full_outer")
    return out.select("file", F.col("got").alias("md5"), F.when(F.col("want").isNotNull(), F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("verified"))


def stale(steps: DataFrame, state: DataFrame, by: str = "extract") -> DataFrame:
    """What a pipeline still has to do: steps (extract, input columns...) whose inputs' hash differs from the one that ``state``
    (extract, input_hash) has for it, with that hash. Rows of one extract are hashed together, in order."""
    columns = [c for c in steps.columns if c != by]
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    now = steps.groupBy(by).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), ";")).alias("input_hash"))
    done = state.select(by, F.col("input_hash").alias("done"))
    return now.join(done, by, "left").where(~F.col("input_hash").eqNullSafe(F.col("done"))).select(by, "input_hash")
