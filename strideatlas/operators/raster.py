"""Map tiles of fog or heat from visit counts: cells meet the tiles that need them (with a margin), then one NumPy kernel a
tile. Asked tiles are rows, so a whole pyramid renders in one job; a tile's cells are bounded by its window."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The heat ramp (intensity, red, green, blue, alpha), its dim colour and size, the least ribbon in pixels.
HEAT_STOPS = ((0.08, 255, 214, 120, 0.55), (0.30, 255, 168, 70, 0.85), (0.55, 255, 104, 56, 0.92), (0.80, 255, 56, 70, 0.96), (1.00, 255, 40, 120, 1.00))
HEAT_DIM, RAMP = (12, 15, 24), 1024
FLOOR_RIBBON_PX, FLOOR_CELL_PX = 6.0, 10 / 3


@dataclass(frozen=True)
class Look:
    mode: str = "fog"
    fog_color: tuple = (20, 24, 32)
    fog_alpha: float = 0.85
    feather: float = 1.5
    halo: float = 0.6
    core_radius: int = 1
    clear_color: tuple | None = None
    clear_alpha: float = 0.0
    heat_dim: float = 0.5
    heat_dim_color: tuple = HEAT_DIM


def level_for_zoom(z: float) -> int:
    return 14 if z >= 14 else 10 if z >= 10 else 6 if z >= 6 else 2


def intensity(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, dtype=np.float32)
    return np.where(c > 0, 0.22 + 0.78 * np.minimum(1, (c - 1) / 7), 0).astype(np.float32)


def ramp() -> np.ndarray:
    v = np.arange(RAMP) / (RAMP - 1)
    stops = np.array(HEAT_STOPS)
    out = np.stack([np.interp(v, stops[:, 0], stops[:, i]) for i in range(1, 5)], axis=1)
    out[v < stops[0, 0]] = (255, 200, 110, 0)
    return out


def smoothstep(a: float, b: float, t: np.ndarray) -> np.ndarray:
    u = np.clip((t - a) / (b - a), 0, 1)
    return u * u * (3 - 2 * u)


def box_sizes(sigma: float, n: int = 3) -> list[int]:
    """Odd widths of n box filters whose run is close to a Gaussian."""
    low = math.floor(math.sqrt(12 * sigma * sigma / n + 1))
    low -= low % 2 == 0
    m = math.floor((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4) + 0.5)
    return [low if i < m else low + 2 for i in range(n)]


def support(sigma: float) -> int:
    return sum((w - 1) // 2 for w in box_sizes(sigma)) if sigma > 0 else 0


def box(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Mean over 2r + 1 neighbours; what lies outside counts as the edge value."""
    if r == 0:
        return x
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r + 1, r)
    s = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
    a, b = [slice(None)] * 2, [slice(None)] * 2
    a[axis], b[axis] = slice(2 * r + 1, None), slice(None, -(2 * r + 1))
    return ((s[tuple(a)] - s[tuple(b)]) / (2 * r + 1)).astype(np.float32)


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    for w in box_sizes(sigma) if sigma > 0 else ():
        x = box(box(x, (w - 1) // 2, 1), (w - 1) // 2, 0)
    return x


def spread_max(x: np.ndarray, r: int) -> np.ndarray:
    """Largest value within r rows and columns, by doubling."""
    for axis in (0, 1):
        n, reach, out = x.shape[axis], 1, np.pad(x, [(r, r) if k == axis else (0, 0) for k in (0, 1)])
        while reach < 2 * r + 1:
            step = min(reach, 2 * r + 1 - reach)
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(None, out.shape[axis] - step), slice(step, None)
            out = np.maximum(out[tuple(a)], out[tuple(b)])
            reach += step
        keep = [slice(None)] * 2
        keep[axis] = slice(0, n)
        x = out[tuple(keep)]
    return x


@dataclass(frozen=True)
class Window:
    """Work field of one tile: scale k, margin m and the cells that it covers."""

    level: int
    cells: float
    k: int
    cpw: float
    m: int
    r: int
    dil: int
    ribbon: float
    scale: float

    @staticmethod
    def of(z: int, size: int, look: Look) -> Window:
        level = level_for_zoom(z + math.log2(size / 512))
        cells = 2.0 ** (level + 8 - z)
        px, k = size / cells, 1
        while px / k > 4 and size % (2 * k) == 0:
            k *= 2
        cpw = px / k
        dil = 1 if level == 14 and look.core_radius else 0
        nominal = (2 * dil + 1) * cpw
        floored = nominal < FLOOR_RIBBON_PX
        scale = max(cpw, FLOOR_CELL_PX) if floored else cpw
        target = (3 if dil or level != 14 else 2) * FLOOR_CELL_PX if floored else nominal
        r = 0 if nominal >= target else math.ceil((target - nominal) / 2)
        ribbon = max(nominal, 1) + 2 * r
        sigma = max(look.feather * scale, 0.3 * ribbon) if look.mode == "fog" else scale
        m = max(2, math.ceil(3 * sigma), support(sigma) + 1) + r
        return Window(level, cells, k, cpw, m, r, dil, ribbon, scale)

    def span(self, at: int, size: int) -> tuple[int, int]:
        """Cells [first, end) along one axis for tile number ``at``."""
        first = at * self.cells
        return math.floor(first - self.m / self.cpw) - self.dil, math.ceil(first + (size // self.k + self.m) / self.cpw) + self.dil


def pool(win: np.ndarray, first: float, w: Window, low: int, n: int, axis: int) -> np.ndarray:
    """Work pixels along an axis: the cell under each, or the largest of the cells that share it."""
    edge = first + (np.arange(n + 1) - w.m) / w.cpw - low
    if w.cpw >= 1:
        at = np.clip(np.floor(edge[:-1] + 1e-9).astype(int), 0, win.shape[axis] - 1)
        return np.take(win, at, axis=axis)
    a, b = np.clip(np.floor(edge[:-1] + 1e-9).astype(int), 0, win.shape[axis] - 1), np.clip(np.ceil(edge[1:] - 1e-9).astype(int), 1, win.shape[axis])
    parts = [np.max(np.take(win, range(i, max(i + 1, j)), axis=axis), axis=axis) for i, j in zip(a, b, strict=True)]
    return np.stack(parts, axis=axis)


def bilinear(x: np.ndarray, w: Window, size: int) -> np.ndarray:
    if w.k == 1:
        return x[w.m : w.m + size, w.m : w.m + size]
    s = (np.arange(size) + 0.5) / w.k - 0.5 + w.m
    i, t = np.floor(s).astype(int), (s - np.floor(s)).astype(np.float32)
    rows = x[i] * (1 - t)[:, None] + x[i + 1] * t[:, None]
    return rows[:, i] * (1 - t) + rows[:, i + 1] * t


def clamp8(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(x, 0, 255)).astype(np.uint8)


def flat(size: int, look: Look) -> np.ndarray:
    color, alpha = (look.fog_color, look.fog_alpha) if look.mode == "fog" else (look.heat_dim_color, look.heat_dim)
    return np.broadcast_to(clamp8(np.array([*color, alpha * 255])), (size, size, 4)).copy()


def render(z: int, x: int, y: int, cx: np.ndarray, cy: np.ndarray, count: np.ndarray, size: int, look: Look) -> np.ndarray:
    """RGBA (size, size, 4) of a tile from the cells of its window, at the window's level."""
    w = Window.of(z, size, look)
    (x0, x1), (y0, y1) = w.span(x, size), w.span(y, size)
    inside = (cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1) & (count > 0)
    if not inside.any():
        return flat(size, look)
    win = np.zeros((y1 - y0, x1 - x0), dtype=np.int32)
    np.maximum.at(win, (cy[inside] - y0, cx[inside] - x0), count[inside])
    if w.dil:
        win = spread_max(win, 1)
    n = size // w.k + 2 * w.m
    field = pool(pool(win, y * w.cells, w, y0, n, 0), x * w.cells, w, x0, n, 1)
    cover = (field > 0).astype(np.float32)
    if look.mode == "fog":
        cover = spread_max(cover, w.r) if w.r else cover
        narrow, wide = (bilinear(blur(cover, s), w, size) for s in (0.3 * w.ribbon, look.feather * w.scale))
        clear = np.maximum(smoothstep(0.3, 0.85, narrow), look.halo * smoothstep(0.03, 0.5, wide))[..., None]
        fog = look.fog_alpha * (1 - clear)
        glow = look.clear_alpha * clear if look.clear_color else np.zeros_like(clear)
        fog = fog * (1 - glow)
        alpha = glow + fog
        color = np.where(alpha > 0, (np.array(look.clear_color or (0, 0, 0)) * glow + np.array(look.fog_color) * fog) / np.where(alpha > 0, alpha, 1), look.fog_color)
        return clamp8(np.concatenate([color, alpha * 255], axis=2))
    heat = intensity(field)
    if w.r:
        heat, cover = spread_max(heat, w.r), spread_max(cover, w.r)
    heat, cover = bilinear(blur(heat, w.scale), w, size), bilinear(blur(cover, w.scale), w, size)
    colors = ramp()[np.clip((heat * (RAMP - 1)).astype(int), 0, RAMP - 1)]
    glow = (colors[..., 3] * smoothstep(0.02, 0.2, cover))[..., None]
    dim = look.heat_dim * (1 - glow)
    alpha = glow + dim
    color = np.where(glow > 0, (colors[..., :3] * glow + np.array(look.heat_dim_color) * dim) / np.where(alpha > 0, alpha, 1), look.heat_dim_color)
    return clamp8(np.concatenate([color, alpha * 255], axis=2))


def tiles(asked: DataFrame, levels: DataFrame, size: int = 256, look: Look = Look()) -> DataFrame:  # noqa: B008
    """asked (z, x, y), levels (level, cx, cy, count) -> z, x, y, rgba. Cells are dealt to the tiles whose window holds
    them by an equi-join on (level, coarse block); tiles without cells come out flat."""
    block = 256
    spans = asked.select("z", "x", "y").distinct()

    def windows(batches):
        for pdf in batches:
            rows = []
            for z, x, y in pdf[["z", "x", "y"]].itertuples(index=False):
                w = Window.of(int(z), size, look)
                (x0, x1), (y0, y1) = w.span(int(x), size), w.span(int(y), size)
                rows += [(z, x, y, w.level, bx, by) for bx in range(x0 // block, (x1 - 1) // block + 1) for by in range(y0 // block, (y1 - 1) // block + 1)]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "level", "bx", "by"])

    wanted = spans.mapInPandas(windows, "z int, x int, y int, level int, bx int, by int")
    cells = levels.select("level", "cx", "cy", "count", F.floor(F.col("cx") / block).cast("int").alias("bx"), F.floor(F.col("cy") / block).cast("int").alias("by"))
    rows = wanted.join(cells, ["level", "bx", "by"], "left")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(pdf[c].iloc[0]) for c in ("z", "x", "y"))
        own = pdf.dropna(subset=["cx"])
        rgba = render(z, x, y, own["cx"].to_numpy(dtype=np.int64), own["cy"].to_numpy(dtype=np.int64), own["count"].to_numpy(dtype=np.int64), size, look)
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "rgba": [rgba.tobytes()]})

    return rows.select("z", "x", "y", "cx", "cy", "count").groupBy("z", "x", "y").applyInPandas(draw, "z int, x int, y int, rgba binary")
