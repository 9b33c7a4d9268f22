import random

import pytest
from pyspark.sql import functions as F

from strideatlas.functions import geo
from strideatlas.operators import grid, tracks


def fold(ops):
    x = 0
    for kind, v in ops:
        x = max(x, v) if kind == "max" else min(255, x + 1)
    return x


def test_op_log_equals_a_sequential_fold(spark):
    r = random.Random(5)
    logs = {k: [(r.choice(["max", "track", "track"]), r.choice([0, 1, 2, 5, 254, 255])) for _ in range(r.randint(1, 30))] for k in range(300)}
    rows = [(k, i, kind, v) for k, ops in logs.items() for i, (kind, v) in enumerate(ops)]
    got = grid.merged_counts(spark.createDataFrame(rows, "cx int, seq int, kind string, v int"), ["cx"]).collect()
    assert {x["cx"]: x["count"] for x in got} == {k: fold(ops) for k, ops in logs.items()}


@pytest.mark.parametrize(("ops", "want"), [([("max", 5), ("max", 2)], 5), ([("max", 254), ("track", 0), ("track", 0)], 255), ([("track", 0), ("max", 1)], 1), ([("max", 1), ("track", 0)], 2)])
def test_op_log_cases(spark, ops, want):
    df = spark.createDataFrame([(1, i, k, v) for i, (k, v) in enumerate(ops)], "cx int, seq int, kind string, v int")
    assert grid.merged_counts(df, ["cx"]).first()["count"] == want


def test_remark_counts_only_what_the_last_version_lacked(spark):
    rows = [("t", 1, c, 0) for c in (1, 2)] + [("t", 2, 2, 0)] + [("t", 3, c, 0) for c in (1, 2)]
    got = grid.fresh_cells(spark.createDataFrame(rows, "track string, version int, cx int, cy int")).groupBy("cx").count().collect()
    assert {r["cx"]: r["count"] for r in got} == {1: 2, 2: 1}


def test_pyramid_keeps_the_largest_child(spark):
    df = spark.createDataFrame([(16, 16, 3), (17, 30, 9), (400, 16, 1)], "cx int, cy int, count int")
    got = {(r["level"], r["cx"], r["cy"]): r["count"] for r in grid.pyramid(df).collect()}
    assert got[(10, 1, 1)] == 9 and got[(10, 25, 1)] == 1 and got[(2, 0, 0)] == 9


def test_gap_rule_is_strict_and_needs_both_times(spark):
    step = 500 / geo.KY
    rows = [(1, 0, 0.0, 0.0, 0), (1, 1, 0.0, step * 0.999, 1000), (1, 2, 0.0, step * 2.1, 2000), (1, 3, 0.0, step * 2.1, None), (1, 4, 0.0, step * 2.1, 10_000_000)]
    df = spark.createDataFrame(rows, "k int, i int, lon double, lat double, t_ms long")
    assert [r["part"] for r in tracks.split_on_gaps(df, ["k"], ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 2]


def test_cells_along_drops_repeats(spark):
    rows = [(1, i, -74.0 + i * 1e-6, 40.0, i) for i in range(30)]
    cells = tracks.cells_along(spark.createDataFrame(rows, "k int, i int, lon double, lat double, t_ms long"), ["k"], ["i"]).orderBy("i", "k").collect()
    assert all((a["cx"], a["cy"]) != (b["cx"], b["cy"]) for a, b in zip(cells, cells[1:], strict=False))


def test_tile_key_round_trip(spark):
    r = spark.range(1).select(geo.parse_tile_key(geo.tile_key(F.lit(10), F.lit(1023), F.lit(77))).alias("p"), geo.parse_pack_key(F.lit("6/18/24")).alias("c"), geo.parse_pack_key(F.lit("5/1/2")).alias("n")).first()
    assert tuple(r["p"]) == (10, 1023, 77) and tuple(r["c"]) == (18, 24) and r["n"] is None
