"""Import of any files: sniffing, archives, dispatch; one bad file never stops the others.

Files come from Spark's ``binaryFile`` reader, so any store that Spark reads will do, and each task parses its own files."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gpx, timeline, visited_tiles
from .points import POINTS, Tracks, decode, failed

CELLS = "file string, entry string, cx long, cy long, error string"


def kind_column(path: Column, content: Column) -> Column:
    """zip, gpx, json, tile or unknown, by magic bytes, extension and first characters (no parsing)."""
    head = F.ltrim(F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, 512).cast("string")), "^\ufeff", ""))
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    magic = F.hex(F.substring(content, 1, 4))
    return F.when(magic.isin("504B0304", "504B0506"), "zip").when((ext == "gpx") | head.rlike(r"^(<\?xml|<gpx)"), "gpx").when((ext == "json") | head.rlike(r"^[{\[]"), "json").when(base.rlike(r"^[0-9a-fA-F]{4}[olhwjsktri]+[eizxdwknmo]{1,2}$"), "tile").otherwise("unknown")


def entries(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """Entries of an archive that could matter, each inflated when its turn comes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if not name.endswith("/") and "__MACOSX/" not in name:
                yield name, z.read(name)


def is_backup(content: bytes) -> bool:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        metas = sorted((n for n in z.namelist() if n.rsplit("/", 1)[-1] == "meta.json"), key=len)
        return bool(metas) and b'"format"' in z.read(metas[0])


def parse_file(path: str, content: bytes, tz: str = "UTC") -> list[tuple]:
    """Point rows of one file; an archive's GPX under Import/ is left out where the archive holds tiles too."""
    try:
        if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            found = list(entries(path, content))
            tiles = any(visited_tiles.entry_kind(n) == "tile" for n, _ in found)
            rows = []
            for name, data in found:
                low = name.lower()
                if low.endswith(".gpx") and not (tiles and visited_tiles.entry_kind(name) == "junk"):
                    rows += parse_file(f"{path}!{name}", data, tz)
                elif low.endswith(".json"):
                    rows += parse_file(f"{path}!{name}", data, tz)
            return rows
        text = decode(content)
        head = text[:512].lstrip()
        if path.lower().endswith(".gpx") or head.startswith(("<?xml", "<gpx")):
            made: Tracks = gpx.parse(path, text)
        elif path.lower().endswith(".json") or head.startswith(("{", "[")):
            made = timeline.parse(path, text, tz)
        else:
            return [] if visited_tiles.is_tile_name(path.rsplit("/", 1)[-1]) else [failed(path, "unknown", "format not recognised")]
        return made.rows() or [failed(path, made.source, "no track points found")]
    except (ValueError, KeyError, zipfile.BadZipFile, json.JSONDecodeError) as e:
        return [failed(path, "unknown", str(e)[:300])]


def cells_of_file(path: str, content: bytes) -> list[tuple]:
    found = entries(path, content) if content[:4] == b"PK\x03\x04" else [(path, content)]
    rows: list[tuple] = []
    for name, data in found:
        if visited_tiles.entry_kind(name) != "tile":
            continue
        try:
            cx, cy, _, wrong = visited_tiles.decode(name, data)
            rows += [(path, name, int(x), int(y), None) for x, y in zip(cx, cy, strict=True)]
            rows += [(path, name, None, None, f"{wrong} blocks with a wrong count")] if wrong else []
        except (ValueError, zlib.error) as e:
            rows.append((path, name, None, None, str(e)[:300]))
    return rows


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def points(files: DataFrame, tz: str = "UTC") -> DataFrame:
    """files (path, content) -> rows of points; a file's problem is a row with ``error``."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(parse_file(path, content, tz), columns=[x.split()[0] for x in POINTS.split(", ")]).astype({"track_seq": "Int32", "seq": "Int32", "t_ms": "Int64"})

    return files.select("path", "content").mapInPandas(run, POINTS)


def mask_cells(files: DataFrame) -> DataFrame:
    """files (path, content) -> visited cells of bitmap files, in archives or alone."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(cells_of_file(path, content), columns=[x.split()[0] for x in CELLS.split(", ")]).astype({"cx": "Int64", "cy": "Int64"})

    return files.select("path", "content").mapInPandas(run, CELLS)
