"""The point receiver's log: posted GeoJSON batches, paging by key, expiry, and a streaming source over the log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import geo
from .points import time_ms

#: Days that a batch is kept, batches of one page.
KEEP_DAYS, PAGE = 30, 25
BODY = "struct<locations:array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>>"
BATCH = "key string, received long, device string, points array<struct<t:bigint,lon:double,lat:double,acc:double,speed:double>>"


def iso_ms(text: Column) -> Column:
    digits = text.rlike(r"^\d{10,}(\.\d+)?$")
    return F.when(digits, text.cast("double").cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(text)))


def compact(posts: DataFrame, body: str = "body") -> DataFrame:
    """posts (…, body) -> the same with points (sorted by time), dropped and device. Unusable locations are counted; an
    accuracy or speed under zero is left out; a body that is no batch gives no points."""
    parsed = posts.withColumn("l", F.from_json(body, BODY)["locations"])
    lon, lat = lambda x: F.get(x["geometry"]["coordinates"], 0), lambda x: F.get(x["geometry"]["coordinates"], 1)
    positive = lambda v: F.when(v.try_cast("double") >= 0, v.try_cast("double"))
    point = lambda x: F.struct(iso_ms(x["properties"]["timestamp"]).alias("t"), lon(x).alias("lon"), lat(x).alias("lat"), positive(x["properties"]["horizontal_accuracy"]).alias("acc"), positive(x["properties"]["speed"]).alias("speed"))
    usable = lambda p: p["t"].isNotNull() & geo.is_finite_lon_lat(p["lon"], p["lat"])
    every = F.transform(F.coalesce("l", F.array().cast(BODY.split("locations:")[1][:-1])), point)
    devices = F.filter(F.transform(F.col("l"), lambda x: F.when(usable(point(x)), x["properties"]["device_id"])), lambda d: d.isNotNull() & (d != ""))
    out = parsed.withColumn("points", F.array_sort(F.filter(every, usable))).withColumn("dropped", F.size(every) - F.size("points"))
    return out.withColumn("device", F.coalesce(F.substring(F.get(devices, 0), 1, 64), F.lit(""))).drop("l")


#: Fixed value: keys that one call deletes.
DELETE_CHUNK = 40


def pull(batches: DataFrame, since: str = "", limit: int = PAGE) -> DataFrame:
    """Batches after the cursor, oldest first, and ``has_more``: whether others follow the page."""
    from pyspark.sql import Window

    page = batches.where(F.col("key") > since).orderBy("key").limit(limit + 1)
    w = Window.orderBy("key")  # a page at most
    numbered = page.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy()))
    return numbered.where(F.col("n") <= limit).withColumn("has_more", F.col("total") > limit).drop("n", "total")


def status(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("batches"), F.max("key").alias("last_key"), F.max("received").alias("last_received"))


def delete_chunk(batches: DataFrame, most: int = DELETE_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(what stays, deleted and more): one call deletes the oldest ``most`` keys; the caller goes on while ``more``."""
    oldest = batches.select("key").distinct().orderBy("key").limit(most)  # a chunk at most
    left = batches.join(F.broadcast(oldest), "key", "left_anti")
    return left, oldest.agg(F.count("*").alias("deleted")).crossJoin(left.limit(1).agg((F.count("*") > 0).alias("more")))  # one row each


def expired(batches: DataFrame, now_ms: int) -> DataFrame:
    """What is still kept."""
    return batches.where(F.col("received") >= now_ms - KEEP_DAYS * 86_400_000)


class Page(InputPartition):
    def __init__(self, path: str, after: str, upto: str):
        self.path, self.after, self.upto = path, after, upto


class ReceiverReader(DataSourceStreamReader):
    """Offsets are keys. The latest offset is the log's last key, so it never falls behind what a restarted query has already
    committed; a micro-batch's keys are cut into pages, one for each task, and a range read twice gives the same rows.

    The log is a Parquet folder that the driver and all executors see; keys sort by time."""

    def __init__(self, options: dict):
        self.path, self.limit, self.since = options["path"], int(options.get("limit", PAGE)), options.get("since", "")

    def keys(self, after: str, upto: str | None = None) -> list[str]:
        import pyarrow.dataset as ds

        wanted = ds.field("key") > after
        table = ds.dataset(self.path).to_table(columns=["key"], filter=wanted if upto is None else wanted & (ds.field("key") <= upto))
        return sorted(set(table.column("key").to_pylist()))

    def last_key(self) -> str:
        """The log's last key, by the files' statistics; only a file without them is read."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        last = self.since
        for fragment in ds.dataset(self.path).get_fragments():
            groups = [g.statistics.get("key") if g.statistics else None for g in fragment.row_groups]
            if all(g and g.get("max") is not None for g in groups):
                found = max((g["max"] for g in groups), default="")
            else:
                found = pc.max(fragment.to_table(columns=["key"]).column("key")).as_py() or ""
            last = max(last, found)
        return last

    def initialOffset(self) -> dict:  # noqa: N802
        return {"key": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"key": self.last_key()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        found = self.keys(start["key"], end["key"])
        edges = [start["key"], *found[self.limit - 1 :: self.limit]]
        edges += [found[-1]] if found and edges[-1] != found[-1] else []
        return [Page(self.path, a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Page) -> Iterator:
        import pyarrow.dataset as ds

        key = ds.field("key")
        table = ds.dataset(partition.path).to_table(columns=[x.split()[0] for x in ("key", "received", "device", "points")], filter=(key > partition.after) & (key <= partition.upto))
        yield from table.to_batches()


class ReceiverSource(DataSource):
    """spark.dataSource.register(ReceiverSource); spark.readStream.format("point_receiver").option("path", …)."""

    @classmethod
    def name(cls) -> str:
        return "point_receiver"

    def schema(self) -> str:
        return BATCH

    def streamReader(self, schema: StructType) -> ReceiverReader:  # noqa: N802
        return ReceiverReader(dict(self.options))


__all__ = ["BATCH", "ReceiverSource", "compact", "delete_chunk", "expired", "iso_ms", "pull", "status", "time_ms"]
