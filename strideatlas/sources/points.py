"""What importers share: rows of points, track ids, lenient numbers and times."""

from __future__ import annotations

import datetime as dt
import math
import re

from ..functions.geo import DEG, KX, KY

#: One row for each point; ``error`` rows carry a file's problem and no point.
POINTS = "file string, source string, track_id string, track_seq int, name string, seq int, lon double, lat double, t_ms long, error string"
GAP_M, GAP_MS = 500.0, 30 * 60_000


def number(v) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str) and v.strip():
        try:
            x = float(v)
        except ValueError:
            return None
        return x if math.isfinite(x) else None
    return None


def time_ms(v) -> int | None:
    """ISO-8601 text, a number of milliseconds, or ten digits and more."""
    if isinstance(v, int | float) and not isinstance(v, bool):
        return int(v) if math.isfinite(v) else None
    if not isinstance(v, str) or not v:
        return None
    if re.fullmatch(r"\d{10,}", v):
        return int(v)
    try:
        t = dt.datetime.fromisoformat(v.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return round((t if t.tzinfo else t.replace(tzinfo=dt.UTC)).timestamp() * 1000)


def good(lon: float | None, lat: float | None) -> bool:
    return lon is not None and lat is not None and math.isfinite(lon) and math.isfinite(lat) and -180 <= lon <= 180 and -90 <= lat <= 90


def metres(a, b) -> float:
    return math.hypot((b[0] - a[0]) * KX * math.cos((a[1] + b[1]) / 2 * DEG), (b[1] - a[1]) * KY)


def split(points: list[tuple], gap_m: float = GAP_M, gap_ms: int = GAP_MS) -> list[list[tuple]]:
    """points (lon, lat, t or None): parts that no gap in distance, or in time where both are timed, runs through."""
    out: list[list[tuple]] = []
    for p in points:
        q = out[-1][-1] if out else None
        late = q is not None and p[2] is not None and q[2] is not None and p[2] - q[2] > gap_ms
        if q is None or late or metres(q, p) > gap_m:
            out.append([])
        out[-1].append(p)
    return out


def js_number(x: float) -> str:
    """A number as ECMAScript prints it, which track ids are made from."""
    if float(x).is_integer() and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    if "e" in text:
        mantissa, exponent = text.split("e")
        e = int(exponent)
        if -7 <= e < 0:
            sign = "-" if mantissa.startswith("-") else ""
            return sign + "0." + "0" * (-e - 1) + mantissa.lstrip("-").replace(".", "")
        text = f"{mantissa}e{e:+d}"
    return text


def fnv1a(text: str) -> int:
    """32-bit hash over UTF-16 units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def track_id(source: str, label: str | None, index: int, points: list[tuple]) -> str:
    ends = [",".join(js_number(x) for x in p if x is not None) for p in (points[0], points[-1])]
    return f"{source}-{fnv1a(f'{source}|{label or ""}|{index}|{len(points)}|{ends[0]}|{ends[1]}'):08x}"


class Tracks:
    """Collects a file's tracks and gives its rows. Ids are 32-bit hashes, which meet by chance in files of thousands of tracks:
    the later track's is then made again from a numbered label, so that no two tracks of a file share one."""

    def __init__(self, file: str, source: str):
        self.file, self.source, self.label, self.tracks = file, source, re.split(r"[/\\]", file)[-1], []
        self.ids: set[str] = set()

    def add(self, points: list[tuple], name: str | None, gap_m: float = GAP_M, gap_ms: int = GAP_MS) -> None:
        for part in split(points, gap_m, gap_ms):
            key, again = track_id(self.source, self.label, len(self.tracks), part), 0
            while key in self.ids:
                again += 1
                key = track_id(self.source, f"{self.label}|{again}", len(self.tracks), part)
            self.ids.add(key)
            self.tracks.append((key, name or self.label, part))

    def rows(self) -> list[tuple]:
        return [(self.file, self.source, key, k, name, i, lon, lat, t, None) for k, (key, name, points) in enumerate(self.tracks) for i, (lon, lat, t) in enumerate(points)]


def failed(file: str, source: str, problem: str) -> tuple:
    return (file, source, None, None, None, None, None, None, None, problem)


def decode(content: bytes) -> str:
    return content.decode("utf-8", errors="replace").removeprefix("﻿")
