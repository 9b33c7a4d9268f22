"""Visited-area bitmap files: name codec and decoder.

A file is a zlib stream: 128 x 128 little-endian 16-bit block ordinals, then blocks of 515 bytes, a 64 x 64 bitmap and three
bytes of which the last two hold the bit count."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Fixed values of the format: digits of an id in a name, of its last two digits, the world's width in tiles, sizes in bytes.
DIGITS, TAIL_DIGITS = "olhwjsktri", "eizxdwknmo"
WIDTH, HEADER, BLOCK = 512, 32_768, 515
NAME = re.compile(r"[0-9a-fA-F]{4}[a-z]+")


def tile_id(name: str) -> int | None:
    """The id that a name spells between its four-character prefix and two-character tail."""
    core = name[4:-2] if len(name) >= 7 else ""
    if not core or any(c not in DIGITS for c in core):
        return None
    found = int("".join(str(DIGITS.index(c)) for c in core))
    return found if found < WIDTH * WIDTH else None


def name_core(number: int) -> str:
    text = str(number)
    return "".join(DIGITS[int(c)] for c in text) + "".join(TAIL_DIGITS[int(c)] for c in text)[-2:]


def is_tile_name(name: str) -> bool:
    found = tile_id(name) if 8 <= len(name) <= 12 and re.fullmatch(r"[0-9a-fA-F]{4}", name[:4]) else None
    return found is not None and name[4:] == name_core(found)


def entry_kind(path: str) -> str:
    """dir, junk, snapshot, tile or other."""
    base = re.split(r"[/\\]", path)[-1]
    if path.endswith(("/", "\\")):
        return "dir"
    if "__MACOSX/" in path or base[:1] in ("", ".", "_") or base in ("FoW-Sync-Lock", "Thumbs.db") or re.search(r"(^|[/\\])Import[/\\]", path):
        return "junk"
    if base.lower().endswith(".fwss"):
        return "snapshot"
    return "tile" if is_tile_name(base) else "other"


def decode(name: str, content: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """cx, cy of visited cells, blocks, blocks whose stored count is wrong. ValueError names what is broken."""
    number = tile_id(re.split(r"[/\\]", name)[-1])
    if number is None:
        raise ValueError("not a tile name")
    try:
        raw = zlib.decompress(content)
    except zlib.error as e:
        raise ValueError(f"not a zlib stream ({e})") from None
    if len(raw) < HEADER:
        raise ValueError(f"{len(raw)} bytes are shorter than the header")
    ordinals = np.frombuffer(raw, dtype="<u2", count=HEADER // 2)
    most = int(ordinals.max())
    if len(raw) != HEADER + most * BLOCK:
        raise ValueError(f"{len(raw)} bytes, {HEADER + most * BLOCK} expected for {most} blocks")
    where = np.flatnonzero(ordinals)
    if not len(where):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 0
    blocks = np.frombuffer(raw, dtype=np.uint8, offset=HEADER).reshape(most, BLOCK)[ordinals[where].astype(int) - 1]
    bits = np.unpackbits(blocks[:, :512], axis=1).reshape(-1, 64, 64)
    stored = ((blocks[:, 513].astype(int) << 8 | blocks[:, 514]) & 0x3FFF) >> 1
    wrong = int((stored != bits.sum(axis=(1, 2))).sum())
    b, py, px = np.nonzero(bits)
    cx = (number % WIDTH << 13) | (where[b] % 128 << 6) | px
    cy = (number // WIDTH << 13) | (where[b] // 128 << 6) | py
    return cx, cy, len(where), wrong


def encode(cells: set[tuple[int, int]]) -> bytes:
    """The file of visited cells of one tile (for tests and exports)."""
    by_block: dict[int, np.ndarray] = {}
    for cx, cy in cells:
        at = (cy >> 6 & 127) * 128 + (cx >> 6 & 127)
        by_block.setdefault(at, np.zeros((64, 64), dtype=np.uint8))[cy & 63, cx & 63] = 1
    ordinals, body = np.zeros(HEADER // 2, dtype="<u2"), b""
    for k, at in enumerate(sorted(by_block), 1):
        ordinals[at] = k
        body += np.packbits(by_block[at], axis=1).tobytes() + b"\0" + (int(by_block[at].sum()) << 1).to_bytes(2, "big")
    return zlib.compress(ordinals.tobytes() + body)
