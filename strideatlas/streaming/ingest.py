"""Incremental ingest: pulled points join their day's track, and the grid is re-marked under the same id.

A point that is stored already wins over one that comes again, so a batch that comes twice after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracks
from ..session import checkpointed


def points_of(batches: DataFrame) -> DataFrame:
    """Receiver batches -> points (arrival, t_ms, lon, lat, acc); arrival orders by key, then place in the batch, as a string of
    fixed width, so no task numbers a whole backlog."""
    rows = batches.select("key", F.posexplode("points").alias("at", "p"))
    arrival = F.concat_ws("-", "key", F.lpad(F.col("at").cast("string"), 6, "0"))
    return rows.select(arrival.alias("arrival"), F.col("p.t").alias("t_ms"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("p.acc").alias("acc"))


def upsert_days(spark: SparkSession, points: DataFrame, path: str, tz: str = "UTC") -> None:
    """Merges points into the day tracks at ``path`` (partitioned by day); only days of the batch are read, and only those that
    grow are written again. A batch that comes twice finds its points stored and changes nothing."""
    schema = "t_ms long, lon double, lat double, day date"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    days = points.select(F.to_date(F.from_utc_timestamp(F.timestamp_millis("t_ms"), tz)).alias("day")).distinct()
    touched = stored.join(days, "day", "left_semi")
    merged = tracks.merge_into_days(points, touched.select("day", "t_ms", "lon", "lat"), tz=tz).drop("is_new")
    kept = checkpointed(merged)  # the old files are read before they are replaced
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str):
    """Receiver stream -> day tracks, page by page; returns the running query."""
    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_days(batch.sparkSession, points_of(batch), path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
