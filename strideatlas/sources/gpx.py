"""GPX tracks: a tag scanner that bears truncated and odd files, and a writer."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .points import Tracks, good, number, time_ms

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[^\s>/]+)(?P<attrs>[^>]*?)(?P<self>/?)>|<(?P<cut>[^>]*)\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(lat|lon)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#(\d{1,7})|(amp|lt|gt|quot|apos));")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    def one(m):
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code <= 0x10FFFF else m[0]

    return ENTITY.sub(one, text) if "&" in text else text


def events(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, payload): open and close of local names (a self-closing tag is both), text between them as it stands."""
    at = 0
    for m in TOKEN.finditer(text):
        if m.start() > at:
            yield "text", "", text[at : m.start()]
        at = m.end()
        if m["cdata"] is not None:
            yield "text", "", m["cdata"]
        elif m["name"]:
            name = m["name"].rpartition(":")[2]
            if not m["close"]:
                yield "open", name, m["attrs"]
            if m["close"] or m["self"]:
                yield "close", name, ""
        elif m["cut"] is not None:
            return
    if at < len(text):
        yield "text", "", text[at:]


def parse(file: str, text: str) -> Tracks:
    """trk / trkseg / trkpt with time; waypoints, routes, extensions and comments are passed over. A point that is cut off
    counts with what it has."""
    tracks = Tracks(file, "gpx")
    name: str | None = None
    segment: list[tuple] = []
    point: list | None = None
    reading, said, skipping, in_track, in_segment = "", "", 0, False, False

    def finish_text():
        nonlocal reading, said, name
        if reading == "time" and point is not None:
            point[2] = time_ms(said.strip())
        elif reading == "name":
            name = unescape(said).strip() or None
        reading, said = "", ""

    def finish_point():
        nonlocal point
        if point is not None and good(point[0], point[1]):
            segment.append(tuple(point))
        point = None

    def finish_segment():
        finish_point()
        if segment:
            tracks.add(segment.copy(), name)
            segment.clear()

    for kind, tag, payload in events(text):
        if kind == "text":
            said += payload if reading else ""
            continue
        finish_text()
        if tag == "extensions":
            skipping = max(0, skipping + (1 if kind == "open" else -1))
        elif skipping:
            continue
        elif tag == "trk":
            if kind == "open":
                in_track, name = True, None
                segment.clear()
            else:
                finish_segment()
                in_track = in_segment = False
                name = None
        elif tag == "trkseg":
            finish_segment()
            in_segment = kind == "open"
        elif tag == "trkpt":
            finish_point()
            if kind == "open":
                found = {k: number(a or b) for k, a, b in ATTRIBUTE.findall(payload)}
                point = [found.get("lon"), found.get("lat"), None]
        elif kind == "open" and (tag == "time" and point is not None or tag == "name" and in_track and not in_segment and point is None and name is None):
            reading = tag
    finish_text()
    finish_segment()
    return tracks


def escape(c: Column) -> Column:
    for raw, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(made))
    return c


def to_gpx(tracks: DataFrame, creator: str = "strideatlas") -> DataFrame:
    """tracks (track_id, name, points array<struct<lon,lat,t_ms>>) -> track_id, gpx (text of a GPX 1.1 document)."""
    stamp = lambda t: F.date_format(F.timestamp_millis(t), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    time = lambda t: F.when(t.isNotNull() & (t != 0), F.concat(F.lit("<time>"), stamp(t), F.lit("</time>"))).otherwise(F.lit(""))
    point = lambda p: F.concat(F.format_string('      <trkpt lat="%.7f" lon="%.7f">', p["lat"], p["lon"]), time(p["t_ms"]), F.lit("</trkpt>\n"))
    first = F.filter("points", lambda p: p["t_ms"].isNotNull() & (p["t_ms"] != 0))
    since = F.when(F.size(first) > 0, F.concat(F.lit("    "), time(F.get(first, 0)["t_ms"]), F.lit("\n"))).otherwise(F.lit(""))
    name = F.concat(F.lit("    <name>"), escape(F.coalesce("name", F.lit("Session"))), F.lit("</name>\n"))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n')
    body = F.array_join(F.transform("points", point), "")
    return tracks.select("track_id", F.concat(head, name, since, F.lit("  </metadata>\n  <trk>\n"), name, F.lit("    <trkseg>\n"), body, F.lit("    </trkseg>\n  </trk>\n</gpx>\n")).alias("gpx"))
