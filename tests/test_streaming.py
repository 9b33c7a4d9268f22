from pyspark.sql import functions as F

from strideatlas.adapter import fixes
from strideatlas.plans.store import GridStore
from strideatlas.sources import receiver
from strideatlas.streaming import ingest, session


def test_stream_equals_its_batch_twin(spark, sf, tmp_path):
    f = fixes(spark, sf).select("device", "fix_id", "t_ms", "lon", "lat", F.col("acc").cast("double").alias("acc"))
    cut = f.agg(F.percentile_approx("t_ms", 0.5)).first()[0]
    for k, part in enumerate((f.where(F.col("t_ms") <= cut), f.where(F.col("t_ms") > cut))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = session.accepted_stream(stream).writeStream.format("memory").queryName("accepted_fixes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("accepted_fixes").collect()))
    assert got == sorted(map(tuple, session.accepted(f).collect())) and got


def test_filter_cases():
    fix = lambda k, t, x, acc=5.0: (1, k, t, x, 40.0, acc)
    state, rows = session.walk(session.START, iter([fix(1, 0, 0.0), fix(2, 1000, 0.0), fix(3, 2000, 1.0), fix(4, 3000, 0.0001), fix(5, 2500, 0.0002), fix(6, 9000, 0.0002, 80.0)]))
    assert [r[1] for r in rows] == [1, 4] and state[4] == 3


def test_day_tracks_take_late_points_and_keep_the_first(spark, tmp_path):
    points = lambda rows: spark.createDataFrame(rows, "arrival long, t_ms long, lon double, lat double, acc double")
    path = str(tmp_path / "days")
    ingest.upsert_days(spark, points([(1, 1000, 1.0, 1.0, None), (2, 90_000_000, 2.0, 2.0, 10.0), (3, 2000, 9.0, 9.0, 90.0)]), path)
    late = points([(4, 1500, 3.0, 3.0, None), (5, 1000, 8.0, 8.0, None)])
    for k in (1, 2):  # the same page twice
        ingest.upsert_days(spark, late, path)
    got = sorted((r["t_ms"], r["lon"]) for r in spark.read.parquet(path).collect())
    assert got == [(1000, 1.0), (1500, 3.0), (90_000_000, 2.0)]


def test_receiver_pages(spark, tmp_path):
    rows = [(f"{1_700_000_000_000 + i:013d}-{i:05d}", 1_700_000_000_000 + i, "d", [(1_700_000_000_000 + i, 1.0, 2.0, None, None)]) for i in range(60)]
    df = spark.createDataFrame(rows, receiver.BATCH)
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    page = receiver.pull(df).collect()
    assert len(page) == 25 and page[0]["has_more"] and len(receiver.pull(df, rows[49][0]).collect()) == 10
    spark.dataSource.register(receiver.ReceiverSource)
    stream = spark.readStream.format("point_receiver").option("path", str(tmp_path / "log")).load()
    q = stream.writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["key"] for r in spark.table("pages").collect()) == [r[0] for r in rows]


def test_session_checkpoints_mark_a_session_once(spark, tmp_path):
    schema = "session_id string, t_ms long, lon double, lat double"
    rows = [("s1", i * 1000, -73.95 + i * 1e-5, 40.7) for i in range(30)] + [("s2", 5, -73.9, 40.7)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10] + (rows[30:] if k == 2 else []), schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    whole = GridStore(spark, str(tmp_path / "whole"))
    line = [{"lon": x, "lat": y, "t_ms": t} for _, t, x, y in rows[:30]]
    want = whole.apply(1, spark.createDataFrame([("s1", "session", "Session s1", line)], "track_id string, source string, name string, points array<struct<lon:double,lat:double,t_ms:bigint>>"))
    store = GridStore(spark, str(tmp_path / "grid"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    session.checkpoint_sessions(stream, store, str(tmp_path / "c")).awaitTermination(180)
    got = store.statistics()
    assert (got["visited_cells"], got["visits"]) == (want["visited_cells"], want["visits"]) and got["version"] == 3
    assert [(r["track_id"], r["points"]) for r in store.list_tracks().collect()] == [("s1", 30)]


def test_last_key_comes_from_statistics(spark, tmp_path):
    rows = [(f"{1_700_000_000_000 + i:013d}-{i:05d}", i, "d", []) for i in range(50)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows[:30], receiver.BATCH).coalesce(1).write.parquet(path)
    spark.createDataFrame(rows[30:], receiver.BATCH).coalesce(2).write.mode("append").parquet(path)
    assert receiver.ReceiverReader({"path": path}).latestOffset() == {"key": rows[-1][0]}
    assert receiver.ReceiverReader({"path": path, "since": "9"}).latestOffset() == {"key": "9"}


def test_sessions_end_with_the_local_day_in_summer_time(spark):
    """New York: midnight is at 5:00 UTC up to 10 March 2024 and at 4:00 UTC from then on; a fixed zone has no such change."""
    times = ["2024-03-10 04:59:59", "2024-03-10 05:00:00", "2024-03-11 03:59:59", "2024-03-11 04:00:00", "2024-03-11 05:00:00"]
    fixes = spark.createDataFrame([(7, t) for t in times], "device long, t string").selectExpr("device", "unix_millis(timestamp(t)) AS t_ms")
    days = lambda tz: [r["session_id"] for r in session.rolled_over(fixes, tz).orderBy("t_ms").collect()]
    assert days("America/New_York") == ["7-20240309", "7-20240310", "7-20240310", "7-20240311", "7-20240311"]
    assert days("-05:00") == ["7-20240309", "7-20240310", "7-20240310", "7-20240310", "7-20240311"]
