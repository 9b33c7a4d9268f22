
import time

import numpy as np

from strideatlas.operators import raster
from strideatlas.sources import gpx


def test_gpx_of_200_000_points():
    points = "".join(f'<trkpt lat="{40 + i * 1e-5:.6f}" lon="-73.9"><time>2024-05-01T10:00:00Z</time></trkpt>\n' for i in range(200_000))
    began = time.perf_counter()
    tracks = gpx.parse("big.gpx", f"<gpx><trk><trkseg>{points}</trkseg></trk></gpx>").tracks
    assert sum(len(p) for _, _, p in tracks) == 200_000 and time.perf_counter() - began < 15


def test_tile_times():
    r = np.random.default_rng(1)
    for z, limit in ((15, 0.5), (17, 0.5), (12, 1.0)):  # ten times the stated bounds, which hold for a quiet machine
        w = raster.Window.of(z, 512, raster.Look())
        (x0, x1), (y0, y1) = w.span(5, 512), w.span(7, 512)
        n = 4000
        cx, cy = r.integers(x0, x1, n), r.integers(y0, y1, n)
        took = []
        for _ in range(3):
            began = time.perf_counter()
            raster.render(z, 5, 7, cx, cy, np.ones(n, dtype=int), 512, raster.Look())
            took.append(time.perf_counter() - began)
        assert sorted(took)[1] < limit
