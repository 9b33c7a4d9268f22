import io
import json
import random
import re
import zipfile

import numpy as np
import pytest

from strideatlas.operators import raster
from strideatlas.sources import backup, gpx, importer, osm_pbf, overpass, timeline, visited_tiles
from strideatlas.sources.points import fnv1a, js_number, track_id

GPX = """<?xml version='1.0'?><gpx><wpt lat="1" lon="1"><name>no</name></wpt><trk><name><![CDATA[A & B]]></name><!-- <trkpt lat="9" lon="9"/> -->
<trkseg><trkpt lat='40.70' lon='-73.95'><time>2024-05-01T10:00:00Z</time><extensions><time>1999-01-01T00:00:00Z</time></extensions></trkpt>
<trkpt lon="-73.9501" lat="40.7001"><ele>3</ele><time>2024-05-01T10:00:05Z</time></trkpt></trkseg><trkseg><trkpt lat="40.71" lon="-73.95"/></trkseg></trk>
<trk><name>Q &amp; &#65;</name><trkseg><trkpt lat="40.72" lon="-73.95"><time>2024-05-01T11:00:00Z</time>"""


def test_gpx_bears_odd_and_cut_files():
    t = gpx.parse("x/a.gpx", GPX).tracks
    assert [name for _, name, _ in t] == ["A & B", "A & B", "Q & A"]
    assert [len(p) for _, _, p in t] == [2, 1, 1] and t[0][2][1][2] - t[0][2][0][2] == 5000 and t[1][2][0][2] is None and t[2][2][0][2] == 1714561200000
    assert gpx.parse("e.gpx", "").tracks == [] and gpx.parse("p.gpx", "plain < text").tracks == []
    ns = gpx.parse("n.gpx", '<g:gpx><g:trk><g:trkseg><g:trkpt lat="1" lon="2"></g:trkpt></g:trkseg></g:trk></g:gpx>').tracks
    assert ns[0][2] == [(2.0, 1.0, None)]


def test_ids_follow_utf16_units():
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C
    assert js_number(40.0) == "40" and js_number(1e-7) == "0.0000001" and js_number(-73.95) == "-73.95" and js_number(0.00001) == "0.00001"


def test_tracks_of_a_file_share_no_id():
    """The hashes of these two tracks are equal; the first keeps its id, both have the form of one, and reruns agree."""
    point = '<trkpt lat="{}" lon="{}"/>'.format
    text = f"<gpx><trk><trkseg>{point(40.00227, 0.00064)}{point(40, 0)}</trkseg><trkseg>{point(41.00317, 0.00063)}{point(41, 0)}</trkseg></trk></gpx>"
    found = gpx.parse("a.gpx", text).tracks
    assert [track_id("gpx", "a.gpx", k, points) for k, (_, _, points) in enumerate(found)] == ["gpx-cbd53969"] * 2
    ids = [key for key, _, _ in found]
    assert ids[0] == "gpx-cbd53969" != ids[1] and all(re.fullmatch("gpx-[0-9a-f]{8}", key) for key in ids)
    assert ids == [key for key, _, _ in gpx.parse("a.gpx", text).tracks]


@pytest.mark.parametrize("v", ["40.5, -73.9", "40.5°, -73.9°", {"latLng": "40.5°,-73.9°"}, {"latitude": 40.5, "longitude": "-73.9"}, {"lat": 40.5, "lng": -73.9}, {"latitudeE7": 405000000, "longitudeE7": -739000000}, {"latE7": 405000000, "lngE7": -739000000}])
def test_places(v):
    assert timeline.place(v) == (-73.9, 40.5)


def test_timeline_segments_and_raw_signals():
    seg = {"startTime": "2024-05-01T08:00:00Z", "timelinePath": [{"point": "40.7°, -73.9°", "durationMinutesOffsetFromStartTime": "5"}, {"point": "bad"}]}
    doc = {"semanticSegments": [seg, {"startTime": "2024-05-01T09:00:00Z", "visit": {"topCandidate": {"semanticType": "HOME", "placeLocation": {"latLng": "40.7, -73.9"}}}}, {"visit": {}}, {"activity": {"start": "40.7,-73.9", "end": "40.75,-73.9"}}], "rawSignals": [{"position": {"LatLng": "1,1"}}]}
    t = timeline.parse("t.json", json.dumps(doc)).tracks
    assert [n for _, n, _ in t] == ["Timeline 2024-05-01", "Visit (home)", "Activity", "Activity"]
    assert t[0][2][0][2] == 1714550700000
    raw = timeline.parse("r.json", json.dumps({"rawSignals": [{"position": {"LatLng": "1,1", "accuracyMeters": 800}}, {"position": {"LatLng": "1,1", "accuracyMeters": 20}}]})).tracks
    assert sum(len(p) for _, _, p in raw) == 1
    assert timeline.parse("n.json", "3").tracks == []


def tile(ident: int, n: int, seed: int) -> tuple[str, bytes, set]:
    r = random.Random(seed)
    x, y = ident % 512 << 13, ident // 512 << 13
    cells = {(x | r.randint(0, 8191), y | r.randint(0, 300)) for _ in range(n)}
    return f"a1b2{visited_tiles.name_core(ident)}", visited_tiles.encode(cells), cells


def test_visited_tiles_round_trip():
    name, content, cells = tile(210844, 500, 1)
    assert visited_tiles.is_tile_name(name) and not visited_tiles.is_tile_name(name[:-1] + ("e" if name[-1] != "e" else "i"))
    cx, cy, blocks, wrong = visited_tiles.decode(name, content)
    assert set(zip(cx.tolist(), cy.tolist(), strict=True)) == cells and wrong == 0 and blocks > 0
    with pytest.raises(ValueError, match="zlib"):
        visited_tiles.decode(name, b"no")


def test_import_of_an_archive(spark, tmp_path):
    name, content, cells = tile(5000, 40, 2)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr(f"Sync/{name}", content)
        z.writestr("tracks/a.gpx", GPX)
        z.writestr("Import/b.gpx", GPX)
    (tmp_path / "c.json").write_text('{"locations":[{"latitudeE7":1,"longitudeE7":2,"timestampMs":"1700000000000"}]}')
    (tmp_path / "junk.bin").write_bytes(b"\x00\x01")
    files = importer.read_files(spark, str(tmp_path))
    points = importer.points(files).collect()
    assert sum(r["error"] is not None for r in points) == 1
    assert {r["file"].rsplit("/", 1)[-1] for r in points if r["error"] is None} == {"a.gpx", "c.json"}
    assert {(r["cx"], r["cy"]) for r in importer.mask_cells(files).collect()} == cells


def test_pbf_round_trip(spark):
    nodes = [(1, -73.95, 40.7), (2**34, -73.951, 40.701), (7, 0.5, -1.25)]
    ways = [(11, {"highway": "residential", "name": "Ä"}, [1, 2**34, 7]), (12, {"building": "yes"}, [1, 7])]
    for compress in (True, False):
        files = spark.createDataFrame([("x.pbf", bytearray(osm_pbf.write(nodes, ways, compress)))], "path string, content binary")
        b = osm_pbf.blobs(files)
        assert sorted((r[0], round(r[1], 7), round(r[2], 7)) for r in osm_pbf.nodes(b).collect()) == sorted(nodes)
        got = osm_pbf.ways(b).collect()
        assert [(r["way_id"], r["tags"], r["refs"]) for r in got] == [ways[0]]


def test_map_server_json(spark):
    doc = {"elements": [{"type": "way", "id": 1, "tags": {"highway": "path"}, "nodes": [1, 2, 3], "geometry": [{"lat": 1, "lon": 2}, None]}, {"type": "node", "id": 4}, {"type": "way", "id": 2, "nodes": [1], "geometry": [{"lat": 1, "lon": 2}]}]}
    got = overpass.ways(spark.createDataFrame([(json.dumps(doc),), ("{}",)], "json string")).collect()
    assert len(got) == 1 and got[0]["refs"] == [1, 2] and got[0]["coords"][0]["lon"] == 2.0 and got[0]["coords"][1] is None or got[0]["coords"][1]["lon"] is None


def test_backup_round_trip():
    counts, tracks = [(70_000, 300, 3), (70_001, 300, 255)], [{"id": "a", "points": [[1, 2]]}]
    z = backup.to_zip(counts, tracks, 7, 123)
    meta, got, back = backup.from_zip(z)
    assert z == backup.to_zip(counts, tracks, 7, 123) and meta["version"] == 7 and sorted(got) == counts and back == tracks
    with pytest.raises(ValueError, match="no backup"):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").close()
        backup.from_zip(out.getvalue())


def test_spread_max_and_blur_against_plain_loops():
    r = np.random.default_rng(2)
    x = r.integers(0, 9, (23, 17))
    for k in (1, 2, 5):
        want = np.array([[x[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1].max() for j in range(17)] for i in range(23)])
        assert (raster.spread_max(x, k) == want).all()
    flat = np.full((20, 20), 0.5, dtype=np.float32)
    assert np.allclose(raster.blur(flat, 2.3), 0.5, atol=1e-6)


def test_tiles_are_clear_where_cells_are():
    look = raster.Look()
    empty = raster.render(17, 9000, 12000, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 128, look)
    assert (empty == empty[0, 0]).all() and empty[0, 0, 3] == round(look.fog_alpha * 255)
    cx, cy = np.meshgrid(np.arange(9000 * 32 - 40, 9001 * 32 + 40), np.arange(12000 * 32 - 40, 12001 * 32 + 40))
    full = raster.render(17, 9000, 12000, cx.ravel(), cy.ravel(), np.ones(cx.size, int), 128, look)
    assert (full[..., 3] == 0).all()
    heat = raster.render(17, 9000, 12000, cx.ravel(), cy.ravel(), np.full(cx.size, 8), 128, raster.Look(mode="heat"))
    assert (heat[..., 3] == 255).all()
    half = raster.render(17, 9000, 12000, cx[:, :56].ravel(), cy[:, :56].ravel(), np.ones(cx[:, :56].size, int), 128, look)
    assert half[64, 8, 3] == 0 and half[64, 120, 3] > 150
