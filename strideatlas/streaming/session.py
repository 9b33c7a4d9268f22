"""Live sessions: the fix filter, whose state is the last accepted point, as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.points import metres

#: Accuracy and speed that a fix may have, the least step, the gap that adds no distance.
MOST_ACCURACY_M, MOST_SPEED, LEAST_STEP_M, GAP_M = 50.0, 60.0, 1.5, 500.0
PENDING = 8
OUT = "device long, fix_id long, t_ms long, lon double, lat double, step_m double, distance_m double, dropped long"
STATE = "lon double, lat double, t_ms long, distance_m double, dropped long, started boolean"


def walk(state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
    """One device's fixes in order through the filter: (new state, accepted rows)."""
    lon, lat, t, total, dropped, started = state
    out = []
    for device, fix, time, x, y, acc in rows:
        if acc > MOST_ACCURACY_M:
            dropped += 1
            continue
        step = 0.0
        if started:
            step, dt = metres((lon, lat), (x, y)), (time - t) / 1000
            if dt <= 0 or step / max(dt, 0.5) > MOST_SPEED:
                dropped += 1
                continue
            if step < LEAST_STEP_M:
                continue  # standing still is no drop
            total += step if step < GAP_M else 0.0
        lon, lat, t, started = x, y, time, True
        out.append((device, fix, time, x, y, step, total, dropped))
    return (lon, lat, t, total, dropped, started), out


COLUMNS = [x.split()[0] for x in OUT.split(", ")]
START = (0.0, 0.0, 0, 0.0, 0, False)


def ordered(pdf: pd.DataFrame) -> Iterator[tuple]:
    return pdf.sort_values(["t_ms", "fix_id"])[["device", "fix_id", "t_ms", "lon", "lat", "acc"]].itertuples(index=False, name=None)


def accepted(fixes: DataFrame) -> DataFrame:
    """Batch: accepted fixes (device, fix_id, t_ms, lon, lat, acc) with running distance and drops."""
    return fixes.groupBy("device").applyInPandas(lambda pdf: pd.DataFrame(walk(START, ordered(pdf))[1], columns=COLUMNS), OUT)


def accepted_stream(fixes: DataFrame) -> DataFrame:
    """Stream: the same, with the last accepted point kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        after, rows = walk(tuple(now), ordered(pd.concat(list(batches))))
        state.update(after)
        yield pd.DataFrame(rows, columns=COLUMNS)

    return fixes.groupBy("device").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def pending(sessions: DataFrame, most: int = PENDING) -> DataFrame:
    """Unfinished sessions that are offered again: the latest of each id, the newest eight."""
    w = Window.partitionBy("session_id").orderBy(F.desc("saved_ms"))
    return sessions.where("NOT finished").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth").orderBy(F.desc("start_ms"), "session_id").limit(most)


def rolled_over(fixes: DataFrame, tz: str = "UTC") -> DataFrame:
    """fixes with session_id: a device's session ends with the local day and with each launch (``launch``, if there is one)."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_millis("t_ms"), tz), "yyyyMMdd")
    return fixes.withColumn("session_id", F.concat_ws("-", F.col("device").cast("string"), day, *(["launch"] if "launch" in fixes.columns else [])))


def new_cells(cells: DataFrame, visited: DataFrame, by: str = "session_id") -> DataFrame:
    """cells (session_id, cx, cy), visited (cx, cy): how many cells each session touched, and how many of them the grid did not
    have before it. Each cell counts once for a session."""
    own = cells.select(by, "cx", "cy").distinct()
    known = visited.select("cx", "cy").distinct().withColumn("known", F.lit(1))
    return own.join(known, ["cx", "cy"], "left").groupBy(by).agg(F.count("*").alias("cells"), F.count_if(F.col("known").isNull()).alias("new_cells"))


def checkpoint_sessions(accepted_fixes: DataFrame, store, checkpoint: str, source: str = "session"):
    """Stream of accepted fixes (session_id, t_ms, lon, lat) -> the grid: each micro-batch marks its sessions again as a whole,
    under their own ids, so cells count once for a session however often it is marked, and a batch that comes twice changes
    nothing. Sessions of fewer than two points are not kept. Returns the running query."""

    def mark(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        new = batch.select(F.col("session_id").alias("track_id"), F.struct("lon", "lat", "t_ms").alias("p"))
        old = store.latest_tracks().join(new.select("track_id").distinct(), "track_id", "left_semi").select("track_id", F.explode("points").alias("p"))
        points = new.unionByName(old.select("track_id", F.struct("p.lon", "p.lat", "p.t_ms").alias("p"))).distinct()
        whole = points.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("p.t_ms", "p.lon", "p.lat"))).alias("q")).where("size(q) >= 2")
        line = F.transform("q", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["t_ms"].alias("t_ms")))
        marked = whole.select("track_id", F.lit(source).alias("source"), F.concat(F.lit("Session "), "track_id").alias("name"), line.alias("points"))
        store.apply(batch_id, marked, source=source)

    return accepted_fixes.writeStream.foreachBatch(mark).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
