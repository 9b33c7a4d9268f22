"""Exchange formats of the street network: a tile of typed arrays, and a pack of tiles in Morton order.

Native storage is Parquet; these kernels read and write files that others made or need."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of both formats: magic bytes, sizes, the arrays of a tile in order with their types and lengths
#: (n: nodes, n1: nodes + 1, a: arcs, s: shape points).
TILE_MAGIC, PACK_MAGIC, HEADER, ENTRY, PACK_VERSION = b"UFG1", b"UFP1", 32, 16, 1
ARRAYS = (
    ("node_id", "<f8", "n"), ("node_lon", "<i4", "n"), ("node_lat", "<i4", "n"), ("node_flags", "u1", "n"), ("arc_start", "<u4", "n1"), ("arc_to", "<u4", "a"), ("arc_len", "<u2", "a"), ("arc_flags", "u1", "a"),
    ("arc_way", "<u4", "a"), ("arc_shape_start", "<u4", "a"), ("arc_shape_end", "<u4", "a"), ("shape_lon", "<i4", "s"), ("shape_lat", "<i4", "s"),
)
ARC_ROWS = "tile_x int, tile_y int, from_id long, to_id long, len_m int, flags int, way_id long, shape array<struct<lon_e7:int,lat_e7:int>>"
NODE_ROWS = "tile_x int, tile_y int, node_id long, lon_e7 int, lat_e7 int, foreign boolean"


def encode_tile(tx: int, ty: int, arrays: dict, zoom: int = 12) -> bytes:
    """Deflated tile; every array begins at a multiple of eight bytes."""
    n, a, s = len(arrays["node_id"]), len(arrays["arc_to"]), len(arrays["shape_lon"])
    if len(arrays["arc_start"]) != n + 1:
        raise ValueError("arc_start needs a place more than there are nodes")
    raw = struct.pack("<4sIIIIIB7x", TILE_MAGIC, n, a, s, tx, ty, zoom)
    for name, kind, _ in ARRAYS:
        raw += np.asarray(arrays[name]).astype(kind).tobytes()
        raw += b"\0" * (-len(raw) % 8)
    return zlib.compress(raw, 9, -15)


def decode_tile(content: bytes) -> dict:
    raw = zlib.decompress(content, -15)
    magic, n, a, s, tx, ty, zoom = struct.unpack_from("<4sIIIIIB", raw)
    if magic != TILE_MAGIC:
        raise ValueError(f"no graph tile: {magic!r}")
    count, at, out = {"n": n, "n1": n + 1, "a": a, "s": s}, HEADER, {"tx": tx, "ty": ty, "zoom": zoom}
    for name, kind, length in ARRAYS:
        size = np.dtype(kind).itemsize * count[length]
        if at + size > len(raw):
            raise ValueError("graph tile is cut off")
        out[name] = np.frombuffer(raw, dtype=kind, count=count[length], offset=at)
        at += size + -(at + size) % 8
    if at != len(raw):
        raise ValueError(f"graph tile has {len(raw)} bytes, {at} expected")
    return out


def morton(x: int, y: int) -> int:
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16))


def encode_pack(cell: tuple[int, int], tiles: list[tuple[int, int, bytes]], zoom: int = 12, pack_zoom: int = 6) -> bytes:
    if len({(x, y) for x, y, _ in tiles}) != len(tiles) or any((x >> zoom - pack_zoom, y >> zoom - pack_zoom) != cell for x, y, _ in tiles):
        raise ValueError("a tile stands twice or lies in another cell")
    ordered = sorted(tiles, key=lambda t: morton(t[0], t[1]))
    index = HEADER + ENTRY * len(ordered)
    total, entries = index, b""
    for x, y, data in ordered:
        entries += struct.pack("<IIII", x, y, total, len(data))
        total += len(data)
    head = struct.pack("<4sBBBxIIIII4x", PACK_MAGIC, PACK_VERSION, zoom, pack_zoom, *cell, len(ordered), index, total)
    return head + entries + b"".join(data for _, _, data in ordered)


def pack_index(content: bytes) -> dict:
    """Header and entries (tx, ty, offset, length); needs only the first bytes of a pack."""
    if len(content) < HEADER or content[:4] != PACK_MAGIC:
        raise ValueError("no graph pack")
    _, version, zoom, pack_zoom, cx, cy, n, index, total = struct.unpack_from("<4sBBBxIIIII", content)
    if version != PACK_VERSION or index != HEADER + ENTRY * n or len(content) < index:
        raise ValueError("pack version or index is not valid")
    entries = [struct.unpack_from("<IIII", content, HEADER + ENTRY * i) for i in range(n)]
    if any(o < index or o + size > total for _, _, o, size in entries):
        raise ValueError("pack entry out of bounds")
    return {"version": version, "zoom": zoom, "pack_zoom": pack_zoom, "cell": (cx, cy), "total": total, "entries": entries}


def tiles_of_pack(content: bytes) -> list[tuple[int, int, bytes]]:
    return [(x, y, content[o : o + n]) for x, y, o, n in pack_index(content)["entries"]]


def arc_rows(t: dict) -> list[tuple]:
    ids, start = t["node_id"].astype(np.int64), t["arc_start"].astype(int)
    source = np.repeat(np.arange(len(ids)), np.diff(start))
    out = []
    for k, u in enumerate(source):
        a, b = int(t["arc_shape_start"][k]), int(t["arc_shape_end"][k])
        shape = [{"lon_e7": int(x), "lat_e7": int(y)} for x, y in zip(t["shape_lon"][a:b], t["shape_lat"][a:b], strict=True)]
        out.append((t["tx"], t["ty"], int(ids[u]), int(ids[t["arc_to"][k]]), int(t["arc_len"][k]), int(t["arc_flags"][k]), int(t["arc_way"][k]), shape))
    return out


def read_arcs(files: DataFrame) -> DataFrame:
    """files (path, content) of tiles or packs -> arcs."""
    return files.select("content").mapInPandas(lambda batches: (pd.DataFrame([r for c in pdf["content"] for t in each_tile(c) for r in arc_rows(t)], columns=[x.split()[0] for x in ARC_ROWS.replace("array<struct<lon_e7:int,lat_e7:int>>", "array").split(", ")]) for pdf in batches), ARC_ROWS)


def read_nodes(files: DataFrame) -> DataFrame:
    def rows(t: dict) -> list[tuple]:
        return [(t["tx"], t["ty"], int(i), int(x), int(y), bool(f & 1)) for i, x, y, f in zip(t["node_id"], t["node_lon"], t["node_lat"], t["node_flags"], strict=True)]

    return files.select("content").mapInPandas(lambda batches: (pd.DataFrame([r for c in pdf["content"] for t in each_tile(c) for r in rows(t)], columns=[x.split()[0] for x in NODE_ROWS.split(", ")]) for pdf in batches), NODE_ROWS)


def each_tile(content: bytes) -> list[dict]:
    if content[:4] == PACK_MAGIC:
        return [decode_tile(data) for _, _, data in tiles_of_pack(content)]
    return [decode_tile(content)]


TILES = "tile_x int, tile_y int, content binary"


def write_tiles(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """arcs and nodes as network.tiled() gives them -> tile_x, tile_y, content (a deflated tile each)."""

    def make(key, a: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node_id")
        place = {i: k for k, i in enumerate(n["node_id"])}
        a = a.assign(u=a["from_id"].map(place)).sort_values(["u", "rank"])
        shapes, begin, end = [], [], []
        for s in a["shape"]:
            begin.append(len(shapes))
            shapes += [(p["lon_e7"], p["lat_e7"]) for p in (s if s is not None else ())]
            end.append(len(shapes))
        arrays = {
            "node_id": n["node_id"], "node_lon": n["lon_e7"], "node_lat": n["lat_e7"], "node_flags": n["foreign"].astype(int), "arc_start": np.searchsorted(a["u"].to_numpy(), np.arange(len(n) + 1)), "arc_to": a["to_id"].map(place), "arc_len": a["len_m"], "arc_flags": a["flags"], "arc_way": a["way_id"],
            "arc_shape_start": begin, "arc_shape_end": end, "shape_lon": [x for x, _ in shapes], "shape_lat": [y for _, y in shapes],
        }
        return pd.DataFrame({"tile_x": [key[0]], "tile_y": [key[1]], "content": [encode_tile(key[0], key[1], arrays)]})

    nodes = nodes.toDF(*nodes.columns)  # both come from one table of positions: new names keep them apart
    return arcs.groupBy("tile_x", "tile_y").cogroup(nodes.groupBy("tile_x", "tile_y")).applyInPandas(make, TILES)
