"""Image filters: stencils by windows along rows and columns, wider kernels by numpy on one image at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import _grid, _schema, by_image, label_components

# ---- stencils as windows: full images, edge pixels repeated -----------------------------------------------------------


def _along(keys: list[str], axis: str):
    return Window.partitionBy(*keys, "x" if axis == "y" else "y").orderBy(axis)


def _beside(c: str, w) -> tuple[Column, Column]:
    return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))


def sobel(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, y, x, edge: the 3 x 3 gradient length, each direction weighted to sum 1 and both averaged in square."""
    rows, cols = _along(keys, "x"), _along(keys, "y")
    smooth = lambda c, w: (_beside(c, w)[0] + 2 * F.col(c) + _beside(c, w)[1]) / 4
    slope = lambda c, w: (_beside(c, w)[1] - _beside(c, w)[0]) / 2
    p = pixels.select(*keys, "y", "x", F.col(value).cast("double").alias("_v"))
    p = p.withColumns({"_sx": smooth("_v", rows), "_dx": slope("_v", rows)}).withColumns({"_h": slope("_sx", cols), "_w": smooth("_dx", cols)})
    return p.select(*keys, "y", "x", F.sqrt((F.col("_h") * F.col("_h") + F.col("_w") * F.col("_w")) / 2).alias("edge"))


def laplace(pixels: DataFrame, keys: list[str], value: str = "value", out: str = "laplace") -> DataFrame:
    """pixels with the sum of second differences along both axes."""
    (left, right), (up, down) = _beside(value, _along(keys, "x")), _beside(value, _along(keys, "y"))
    return pixels.withColumn(out, left + right + up + down - 4 * F.col(value))


def inner_boundaries(raster: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, inner: labelled pixels with another label, not the outside, among their eight neighbours."""
    rows, cols = _along(keys, "x"), _along(keys, "y")
    low, high = F.lit(2147483647), F.lit(0)
    p = raster.select(*keys, "y", "x", "region_id", F.when(F.col("region_id") > 0, F.col("region_id")).alias("_l"))
    near = lambda c, f, w: f(F.coalesce(c, low if f is F.least else high), F.coalesce(F.lag(c).over(w), low if f is F.least else high), F.coalesce(F.lead(c).over(w), low if f is F.least else high))
    p = p.withColumns({"_a": near(F.col("_l"), F.least, rows), "_b": near(F.col("_l"), F.greatest, rows)})
    p = p.withColumns({"_lo": near(F.col("_a"), F.least, cols), "_hi": near(F.col("_b"), F.greatest, cols)})
    return p.select(*keys, "y", "x", ((F.col("region_id") > 0) & ((F.col("_lo") < F.col("region_id")) | (F.col("_hi") > F.col("region_id")))).alias("inner"))


# ---- kernels ----------------------------------------------------------------------------------------------------------

def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter up to four sigma, edges mirrored."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.arange(-r, n + r) % (2 * n)
        wide = np.take(a, np.where(at < n, at, 2 * n - 1 - at), axis)
        a = sum(w * np.take(wide, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return a


def disk(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels within the disk of a set pixel."""
    out = np.zeros(mask.shape, bool)
    h, w = mask.shape
    for dy, dx in disk(radius):
        out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels whose disk, as far as it lies in the image, is set."""
    return ~dilate(~mask, radius)


def closing(mask: np.ndarray, radius: int) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def opening(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def nearest_to(mask: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest_set at some pixels only: the work is theirs times the image's width."""
    h, w = mask.shape
    if not mask.any() or not len(ys):
        return np.full(len(ys), np.inf), np.full(len(ys), -1), np.full(len(ys), -1)
    rows, x = np.arange(h)[:, None], np.arange(w)
    up = np.maximum.accumulate(np.where(mask, rows, -(10**7)), 0)
    down = np.minimum.accumulate(np.where(mask, rows, 10**7)[::-1], 0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)
    g = (rows - near).astype(float) ** 2
    dist, from_x, step = np.empty(len(ys)), np.empty(len(ys), int), max(1, (1 << 20) // w)
    for i in range(0, len(ys), step):
        d = g[ys[i : i + step]] + (x - xs[i : i + step, None]) ** 2
        from_x[i : i + step] = d.argmin(1)
        dist[i : i + step] = d.min(1)
    return np.sqrt(dist), near[ys, from_x], from_x


def nearest_set(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Euclidean distance of each pixel to the nearest set one, and that one's y and x (of equally near ones the smallest column, then row); infinite without any.

    First the nearest set pixel of each column, then for each row the best column by the lower envelope of parabolas.
    """
    h, w = mask.shape
    if not mask.any():
        return np.full((h, w), np.inf), np.full((h, w), -1), np.full((h, w), -1)
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(mask, rows, -(10**7)), 0)
    down = np.minimum.accumulate(np.where(mask, rows, 10**7)[::-1], 0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)
    g = (rows - near).astype(float) ** 2
    best = np.full((h, w), np.inf)
    from_x = np.zeros((h, w), int)
    x = np.arange(w)
    for c in range(w):  # one column's parabola against all columns, rows at once
        d = g[:, c, None] + (x - c) ** 2
        less = d < best
        best, from_x = np.where(less, d, best), np.where(less, c, from_x)
    return np.sqrt(best), np.take_along_axis(near, from_x, 1), from_x


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Thin edges: ridges of the smoothed gradient above `low` that hang together with one above `high`."""
    gy, gx = np.gradient(gaussian(a.astype(float), sigma))
    m = np.hypot(gy, gx)
    p = np.pad(m, 1)
    turn = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    at = lambda dy, dx: p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    ridge = np.zeros(m.shape, bool)
    for t, (dy, dx) in enumerate(steps):
        ridge |= (turn == t) & (m >= at(dy, dx)) & (m > at(-dy, -dx))
    weak = ridge & (m >= low)
    weak[[0, -1]], weak[:, [0, -1]] = False, False
    keep = weak & (m >= high)
    while True:  # grow along weak edges
        more = dilate(keep, 1) | np.pad(keep, 1)[2:, 2:] | np.pad(keep, 1)[:-2, :-2] | np.pad(keep, 1)[2:, :-2] | np.pad(keep, 1)[:-2, 2:]
        more &= weak
        if (more == keep).all():
            return keep
        keep = more


def equalise(a: np.ndarray, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of values in 0 to 1: each tile's clipped histogram, maps blended between tile centres."""
    h, w = a.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    level = np.clip((a * bins).astype(int), 0, bins - 1)
    maps = np.zeros((ty, tx, bins))
    for i in range(ty):
        for j in range(tx):
            part = level[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            c = np.bincount(part.ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * part.size)
            c = np.minimum(c, most) + np.maximum(c - most, 0).sum() / bins
            maps[i, j] = np.cumsum(c) / part.size
    place = lambda n, cuts: np.interp(np.arange(n), (cuts[:-1] + cuts[1:] - 1) / 2, np.arange(len(cuts) - 1))
    py, px = place(h, ys)[:, None], place(w, xs)[None]
    y0, x0 = np.floor(py).astype(int), np.floor(px).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    fy, fx = py - y0, px - x0
    return (maps[y0, x0, level] * (1 - fx) + maps[y0, x1, level] * fx) * (1 - fy) + (maps[y1, x0, level] * (1 - fx) + maps[y1, x1, level] * fx) * fy


KERNELS = {
    "gaussian": lambda a, sigma=1.0: gaussian(a, sigma),
    "dilate": lambda a, radius=1: dilate(a > 0, radius).astype(float),
    "erode": lambda a, radius=1: erode(a > 0, radius).astype(float),
    "closing": lambda a, radius=1: closing(a > 0, radius).astype(float),
    "opening": lambda a, radius=1: opening(a > 0, radius).astype(float),
    "distance": lambda a: nearest_set(a > 0)[0],
    "canny": lambda a, sigma=1.0, low=0.1, high=0.2: canny(a, sigma, low, high).astype(float),
    "equalise": lambda a, tiles=8, clip=0.01: equalise(a, tiles, clip),
}


def filtered(pixels: DataFrame, keys: list[str], kernel: str, value: str = "value", **parameters) -> DataFrame:
    """keys, y, x, value of full images under one of KERNELS."""

    def run(key, pdf):
        a, y0, x0 = _grid(pdf, value)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "y": y, "x": x, "value": KERNELS[kernel](a, **parameters)[y - y0, x - x0].astype(float)})

    return by_image(pixels, keys, run, _schema(pixels, keys, "y int, x int, value double"))


def tissue(a: np.ndarray) -> np.ndarray | None:
    """Mask of the largest bright region: above 12 % of the 2 to 98 percentile range, closed, islands dropped; None for a flat image. Share and sizes."""
    lo, hi = np.percentile(a, 2), np.percentile(a, 98)
    if hi - lo < 1:
        return None
    h, w = a.shape
    mask = closing(a > lo + (hi - lo) * 0.12, max(3, w // 300))
    lab = label_components(mask.astype(int))
    ids, n = np.unique(lab[lab > 0], return_counts=True)
    ok = n >= max(500, h * w // 2000)
    return lab == ids[ok][n[ok].argmax()] if ok.any() else None


def detect_tissue(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, ok, box, centroid and area of each image's dominant tissue."""

    def run(key, pdf):
        a, y0, x0 = _grid(pdf, value)
        m = tissue(a)
        row = dict(zip(keys, key, strict=True))
        if m is None:
            return pd.DataFrame([{**row, "ok": False, "top": None, "left": None, "bottom": None, "right": None, "cy": None, "cx": None, "area": 0}])
        y, x = np.nonzero(m)
        return pd.DataFrame([{**row, "ok": True, "top": y.min() + y0, "left": x.min() + x0, "bottom": y.max() + 1 + y0, "right": x.max() + 1 + x0, "cy": y.mean() + y0, "cx": x.mean() + x0, "area": len(y)}])

    return by_image(pixels, keys, run, _schema(pixels, keys, "ok boolean, top int, left int, bottom int, right int, cy double, cx double, area long"))
