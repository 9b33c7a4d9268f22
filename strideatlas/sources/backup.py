"""Snapshots of the grid: one zip with meta data, dense base tiles and tracks; and back into rows.

The native snapshot is Parquet (save / load); the zip is for exchange and meant for one person's grid."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "grid-backup", 1


def to_zip(counts: list[tuple[int, int, int]], tracks: list[dict], version: int, updated_ms: int) -> bytes:
    """counts (cx, cy, count), tracks (id, source, name, points) -> zip bytes; times are given, so equal input gives equal bytes."""
    dense: dict[tuple[int, int], np.ndarray] = {}
    for cx, cy, c in counts:
        dense.setdefault((cx >> 8, cy >> 8), np.zeros(65_536, dtype=np.uint8))[(cy & 255) * 256 + (cx & 255)] = min(255, c)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, data: bytes):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)

        put("meta.json", json.dumps({"format": FORMAT, "v": VERSION, "version": version, "updatedAt": updated_ms, "tiles": len(dense), "tracks": len(tracks)}).encode())
        for (tx, ty), data in sorted(dense.items()):
            put(f"tiles/14/{tx}/{ty}", data.tobytes())
        put("tracks.json", json.dumps(sorted(tracks, key=lambda t: t["id"])).encode())
    return out.getvalue()


def from_zip(content: bytes) -> tuple[dict, list[tuple[int, int, int]], list[dict]]:
    """(meta, counts, tracks); ValueError for a foreign or newer file, or a tile of a wrong size."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "meta.json" not in z.namelist():
            raise ValueError("no backup: meta.json is missing")
        meta = json.loads(z.read("meta.json"))
        if meta.get("format") != FORMAT or meta.get("v", 0) > VERSION:
            raise ValueError(f"backup format {meta.get('format')} {meta.get('v')} is not known")
        counts = []
        for name in z.namelist():
            if name.startswith("tiles/14/"):
                data = np.frombuffer(z.read(name), dtype=np.uint8)
                if len(data) != 65_536:
                    raise ValueError(f"{name}: {len(data)} bytes")
                tx, ty = map(int, name.split("/")[2:])
                counts += [(tx * 256 + int(i) % 256, ty * 256 + int(i) // 256, int(data[i])) for i in np.flatnonzero(data)]
        return meta, counts, json.loads(z.read("tracks.json"))


def restore(counts: DataFrame, tracks: DataFrame, saved_counts: DataFrame, saved_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Backup into a grid: cells take the larger count; tracks come in only if their id is new, and are not counted again."""
    both = counts.select("cx", "cy", "count").unionByName(saved_counts.select("cx", "cy", "count"))
    return both.groupBy("cx", "cy").agg(F.max("count").alias("count")), tracks.unionByName(saved_tracks.join(tracks, "track_id", "left_anti").select(*tracks.columns))


def save(df: DataFrame, path: str) -> None:
    df.withColumn("tx", F.shiftright("cx", 14)).write.mode("overwrite").partitionBy("tx").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("tx")
