import json

from pyspark.sql import functions as F

from strideatlas.operators import prefetch
import pytest

from strideatlas.plans.store import Areas, GridStore
from strideatlas.sources import geocode

TRACK = "track_id string, source string, name string, points array<struct<lon:double,lat:double,t_ms:bigint>>"


def test_store_marks_once_and_remembers(spark, tmp_path):
    store = GridStore(spark, str(tmp_path / "grid"))
    assert store.statistics()["visited_cells"] == 0
    line = [{"lon": -73.95 + i * 1e-5, "lat": 40.7, "t_ms": 1000 * i} for i in range(20)]
    track = lambda points, k="a": spark.createDataFrame([(k, "gpx", "A", points)], TRACK)
    one = store.apply(1, track(line))
    again = store.apply(2, track(line))
    assert again["visits"] == one["visits"] and again["version"] == 2
    two = store.apply(3, track(line, "b"))
    assert two["visits"] == 2 * one["visits"] and two["visited_cells"] == one["visited_cells"]
    longer = store.apply(4, track([*line, {"lon": -73.9495, "lat": 40.7001, "t_ms": None}]))
    assert longer["visited_cells"] > two["visited_cells"]
    assert [r["track_id"] for r in store.list_tracks().collect()] == ["a", "b"]
    assert store.delete_track("a")["visits"] == longer["visits"] and [r["track_id"] for r in store.list_tracks().collect()] == ["b"]
    cx, cy = store.counts().select("cx", "cy").first()
    masked = store.apply(5, masks=spark.createDataFrame([(cx, cy, 9)], "cx int, cy int, v int"))
    assert masked["visited_cells"] == longer["visited_cells"] and store.counts().where(f"cx = {cx} AND cy = {cy}").first()["count"] == 9
    gone = store.delete_all(6)
    assert gone["visited_cells"] == 0 and gone["version"] == 6 and store.list_tracks().count() == 0


def test_prefetch_decisions(spark):
    rows = [(None, 1, True, False, False, 0, "no-centre"), (1, 1, False, False, False, 0, "offline"), (1, 1, True, True, False, 0, "save-data"), (5, 5, True, False, False, 9_000, "unchanged"), (5, 5, True, False, True, 9_000, "fetch"), (1, 1, True, False, False, 1_000, "throttled")]
    df = spark.createDataFrame(rows, "x int, y int, online boolean, save boolean, pending boolean, now long, want string")
    got = df.select("want", prefetch.decision(F.col("x"), F.col("y"), F.lit(5), F.lit(5), F.col("online"), F.col("save"), F.col("pending"), F.col("now"), F.lit(0)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_places_are_shaped_and_distinct(spark):
    f = lambda **p: {"geometry": {"coordinates": [1.5, 2.5]}, "properties": p}
    doc = {"features": [f(name="Park", city="NYC", state="NY", country="US", county="Kings"), f(name="Park", city="NYC", state="NY", country="US", county="Kings"), f(street="Main St", housenumber="5", city="NYC"), f(country="US", osm_value="country")]}
    got = geocode.places(spark.createDataFrame([(1, json.dumps(doc))], "id int, json string")).orderBy("place").collect()
    assert [(r["name"], r["locality"]) for r in got] == [("Park", "NYC, Kings, NY"), ("Main St 5", "NYC"), ("US", "")] and got[2]["kind"] == "country" and got[0]["lon"] == 1.5


def test_a_change_that_failed_half_way_has_not_happened(spark, tmp_path):
    store = GridStore(spark, str(tmp_path / "grid"))
    line = [{"lon": -73.95 + i * 1e-5, "lat": 40.7, "t_ms": 1000 * i} for i in range(20)]
    track = spark.createDataFrame([("a", "gpx", "A", line)], TRACK)
    real = store.commit
    store.commit = lambda seq, at_ms: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.apply(1, track)
    store.commit = real
    assert store.statistics()["visited_cells"] == 0 and store.list_tracks().count() == 0 and store.imports().count() == 0
    done = store.apply(2, track)
    assert done["version"] == 1 and done["visited_cells"] > 0 and done["visits"] == done["visited_cells"] and store.imports().count() == 1


def test_areas_are_stored_listed_and_deleted(spark, tmp_path):
    areas = Areas(spark, str(tmp_path / "areas"))
    assert areas.list().count() == 0
    tiles = spark.createDataFrame([(x, y, bytes(10)) for x in range(1200, 1215) for y in range(1530, 1550)], "tx int, ty int, bytes binary")
    one = areas.store("home", -73.95, 40.7, 4.0, tiles, 1).collect()
    two = {r["area_id"]: r for r in areas.store("far", -74.2, 40.7, 8.0, tiles, 2).collect()}
    assert len(one) == 1 and set(two) == {"home", "far"} and two["far"]["tiles"] > two["home"]["tiles"] == one[0]["tiles"] > 0 and two["home"]["bytes"] == 10 * two["home"]["tiles"]
    again = {r["area_id"]: r for r in areas.store("home", -73.95, 40.7, 1.0, tiles, 3).collect()}
    assert again["home"]["at_ms"] == 3 and again["home"]["tiles"] <= one[0]["tiles"] and again["far"]["tiles"] == two["far"]["tiles"]
    assert [r["area_id"] for r in areas.delete("home").collect()] == ["far"]
    with pytest.raises(ValueError, match="radius"):
        areas.store("wide", 0.0, 0.0, 9.0, tiles, 4)
