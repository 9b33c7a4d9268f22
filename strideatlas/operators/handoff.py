"""Hand-off of routes to navigation apps: simplification, splitting and their checks, one route a kernel call."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geo import DEG, KX, KY
from ..sources.points import metres

#: Corners that an app takes, deviation of a part, least deviation of a corner.
MOST_CORNERS, MOST_DEVIATION_M, LEAST_CORNER_M = 9, 60.0, 15.0
PARTS = "route long, part int, first_point int, last_point int, corners array<int>, residual_m double, length_m double"


def plane(points: np.ndarray, origin: np.ndarray | None = None) -> np.ndarray:
    o = points[0] if origin is None else origin
    return (points - o) * [KX * math.cos(o[1] * DEG), KY]


def deviations(xy: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the vertices between a and b from the segment a-b."""
    p, d = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
    l2 = float(d @ d)
    t = np.clip(p @ d / l2, 0, 1) if l2 > 0 else np.zeros(len(p))
    return np.hypot(*(p - t[:, None] * d).T)


def corners(xy: np.ndarray, first: int, last: int, most: int, least_m: float) -> tuple[list[int], float]:
    """The vertices that deviate most, one by one (ties: the lower), up to a number or until none deviates by more than
    ``least_m``; and the largest deviation left."""
    chosen, worst = [first, last], {}

    def look(a: int, b: int):
        d = deviations(xy, a, b) if b - a > 1 else np.zeros(0)
        k = int(d.argmax()) if len(d) else -1
        worst[a] = (float(d[k]), a + 1 + k, b) if k >= 0 else (0.0, -1, b)

    look(first, last)
    while True:
        a = min(worst, key=lambda s: (-worst[s][0], worst[s][1] if worst[s][1] >= 0 else math.inf))
        d, at, b = worst[a]
        if at < 0 or d <= least_m or len(chosen) - 2 >= most:
            return sorted(chosen)[1:-1], d
        chosen.append(at)
        look(a, at)
        look(at, b)


def deviation(points: np.ndarray, simple: np.ndarray) -> float:
    """The largest distance of any point from the simplified line."""
    xy, line = plane(points), plane(simple, points[0])
    if len(line) == 1:
        return float(np.hypot(*(xy - line[0]).T).max())
    best = np.full(len(xy), math.inf)
    for a, b in zip(line, line[1:], strict=False):
        d = b - a
        l2 = float(d @ d)
        t = np.clip((xy - a) @ d / l2, 0, 1) if l2 > 0 else np.zeros(len(xy))
        best = np.minimum(best, np.hypot(*(xy - a - t[:, None] * d).T))
    return float(best.max())


def distinct_points(points: np.ndarray) -> np.ndarray:
    keep = np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)])
    return points[keep]


def split_parts(points: np.ndarray, most: int = MOST_CORNERS, within_m: float = MOST_DEVIATION_M, least_m: float = LEAST_CORNER_M) -> list[tuple[int, int, list[int], float]]:
    """Parts (first, last, corners, residual), each as long as it goes: a part takes one point after the other as long as its
    corners keep it within the bound, and ends before the first that does not fit, even if a later one would. Points that are
    all corners or ends fit anyway, so growing starts there."""
    xy, out, first = plane(points), [], 0
    while first < len(xy) - 1:
        lasts = range(min(len(xy) - 1, first + most + 1), len(xy))
        tried = ((last, *corners(xy, first, last, most, least_m)) for last in lasts)
        good = None
        for trial in tried:
            if good is not None and trial[2] > within_m:
                break
            good = trial
        out.append((first, *good))
        first = good[0]
    return out


def walkable_runs(coords: list, legs: list | None) -> list[np.ndarray]:
    """What an app can be handed: the route cut at its straight legs, each run of streets and paths between them by itself; the
    whole route if it has no legs, no straight leg or nothing else."""
    whole = [distinct_points(np.array([(c["lon"], c["lat"]) for c in coords]))] if len(coords) else []
    kinds = [x["kind"] for x in legs] if legs is not None else []
    if "straight" not in kinds:
        return whole
    runs: list[list] = [[]]
    for leg in legs:
        if leg["kind"] == "straight":
            runs.append([])
        else:
            runs[-1] += [(c["lon"], c["lat"]) for c in leg["coords"]]
    return [distinct_points(np.array(x)) for x in runs if len(x) >= 2] or whole


def parts(routes: DataFrame) -> DataFrame:
    """routes (route, coords array<struct<lon,lat>>, optionally legs array<struct<kind, coords>>) -> the parts that an app can take.
    Points are numbered through a route's runs. A route is one kernel call, so its points have to fit a task."""
    columns = ["route", "coords", *(["legs"] if "legs" in routes.columns else [])]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                number, before = 0, 0
                for points in walkable_runs(r.coords, getattr(r, "legs", None)):
                    for a, b, own, residual in split_parts(points) if len(points) > 1 else []:
                        rows.append((r.route, number, before + a, before + b, [before + i for i in own], residual, sum(metres(points[i], points[i + 1]) for i in range(a, b))))
                        number += 1
                    before += len(points)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.replace("array<int>", "array").split(", ")])

    return routes.select(*columns).mapInPandas(run, PARTS)
