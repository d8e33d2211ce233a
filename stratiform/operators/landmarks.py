"""Point correspondences between images: cuts, tables, ranges, fits, corners and robust models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import _grid, _schema, smooth

AP_LAST = 528


def displacement_cut(pairs: DataFrame, keys: list[str], axes: list[str], least: float = 10.0, share: float = 0.9) -> DataFrame:
    """Pairs whose displacement is on every axis below the larger of `least` and the axis' percentile in the group."""
    limits = pairs.groupBy(*keys).agg(*[F.greatest(F.lit(least), F.percentile(F.abs(F.col(a)), F.lit(share))).alias(f"_{a}") for a in axes])
    kept = pairs.join(limits, keys)
    for a in axes:
        kept = kept.where(F.abs(F.col(a)) < F.col(f"_{a}"))
    return kept.drop(*[f"_{a}" for a in axes])


def boundary_conditions(pairs: DataFrame) -> DataFrame:
    """fx fy fz mx my mz disp_y disp_z as floats, disp moving less fixed."""
    moved = {"disp_y": F.col("my") - F.col("fy"), "disp_z": F.col("mz") - F.col("fz")}
    return pairs.withColumns(moved).select(*[F.col(c).cast("float").alias(c) for c in ("fx", "fy", "fz", "mx", "my", "mz", "disp_y", "disp_z")])


def ap_range(files: DataFrame, keys: list[str], stem: Column, scale: float, offset: int) -> DataFrame:
    """First and last atlas plane for the slices of a folder, five planes wider and held to 0..528 (F14); the whole atlas where the first or last name has no number after its first letter."""
    number = lambda c: F.substring(c, 2, 1000).try_cast("int")
    ends = files.withColumn("_s", stem).groupBy(*keys).agg(number(F.min("_s")).alias("_a"), number(F.max("_s")).alias("_b"))
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    plane = lambda c: F.expr(f"cast({c} * {float(scale)}D as int)") + offset
    return ends.select(*keys, F.when(known, F.greatest(F.lit(0), plane("_a") - 5)).otherwise(0).alias("ap_start"), F.when(known, F.least(F.lit(AP_LAST), plane("_b") + 5)).otherwise(AP_LAST).alias("ap_end"))


def with_report(qc: DataFrame, report: DataFrame, keys: list[str]) -> DataFrame:
    """qc slices with the report's smoothed z, deviation and outlier mark by slice id.

    report holds arrays that belong together by place, in each group one row. A slice that the report doesn't name keeps its z, with deviation 0 and no mark; where an array is too
    short its value is 0 or false. Of a repeated id the last place counts.
    """
    at = lambda c: F.get(F.col(c), F.col("_i"))
    rows = report.select(*keys, F.posexplode("slice_ids").alias("_i", "slice_id"), "smoothed_z", "deviation", "is_outlier")
    rows = rows.select(*keys, "slice_id", F.struct("_i", F.coalesce(at("smoothed_z").cast("int"), F.lit(0)).alias("z"), F.coalesce(at("deviation").cast("double"), F.lit(0.0)).alias("d"), F.coalesce(at("is_outlier"), F.lit(False)).alias("o")).alias("_v"))
    last = rows.groupBy(*keys, "slice_id").agg(F.max("_v").alias("_v"))
    out = qc.join(last, [*keys, "slice_id"], "left")
    return out.select(*keys, "slice_id", F.col("best_z").alias("original_z"), F.coalesce("_v.z", "best_z").alias("smoothed_z"), F.coalesce("_v.d", F.lit(0.0)).alias("deviation"), F.coalesce("_v.o", F.lit(False)).alias("is_outlier"), F.coalesce("registration_ok", F.lit(True)).alias("registration_ok"))


def contour_average(points: DataFrame, keys: list[str], window: int, least: int = 6) -> DataFrame:
    """Each contour point as the rounded mean of itself and the window - 1 points behind it, around the closed contour (W11). Contours of fewer than `least` points stay. points: ord from 0, x, y."""
    n = F.count("*").over(Window.partitionBy(*keys))
    p = points.withColumn("_n", n)
    copies = F.when(F.col("_n") < least, F.lit(0)).otherwise(F.ceil(F.lit(window - 1) / F.col("_n")).cast("int"))
    p = p.select("*", F.explode(F.sequence(F.lit(0), copies)).alias("_k")).withColumn("_at", F.col("ord") + F.col("_k") * F.col("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_at").rowsBetween(0, window - 1)
    mean = lambda c: F.when(F.col("_n") < least, F.col(c).cast("int")).otherwise(F.bround(F.avg(c).over(ahead), 0).cast("int")).alias(f"_{c}")
    p = p.select(*keys, "ord", "_k", mean("x"), mean("y")).where("_k = 0")
    return p.select(*keys, "ord", F.col("_x").alias("x"), F.col("_y").alias("y"))


# ---- fits --------------------------------------------------------------------------------------------------------

def similarity_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares scale, angle and shift from (x, y) to (u, v) by group, in closed form from sums."""
    s = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"], (F.var_pop("x") + F.var_pop("y")).alias("d"), (F.covar_pop("x", "u") + F.covar_pop("y", "v")).alias("p"), (F.covar_pop("x", "v") - F.covar_pop("y", "u")).alias("q"))
    s = s.where("d > 0").withColumns({"a": F.col("p") / F.col("d"), "b": F.col("q") / F.col("d")})
    return s.select(*keys, F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("scale"), F.atan2("b", "a").alias("angle"), (F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("dx"), (F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("dy"))


def fit_scale(tissue_h: Column, tissue_w: Column, atlas_h: Column, atlas_w: Column, physical: Column, mode: str = "contain") -> Column:
    """How much an atlas box grows to fit a tissue box (M21): the smaller side's factor, the larger one's, one side's, or their geometric mean."""
    h, w = tissue_h / F.greatest(atlas_h * physical, F.lit(1.0)), tissue_w / F.greatest(atlas_w * physical, F.lit(1.0))
    return physical * {"contain": F.least(h, w), "cover": F.greatest(h, w), "width-lock": w, "height-lock": h}.get(mode.lower(), F.sqrt(h * w))


def spline_kernel(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 > 0, 0.5 * d2 * np.log(np.maximum(d2, 1e-300)), 0.0)


def spline_fit(src: np.ndarray, dst: np.ndarray, stiffness: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Thin-plate spline from src to dst points [n, 2]: kernel weights and affine part."""
    n = len(src)
    k = spline_kernel(((src[:, None] - src[None]) ** 2).sum(2)) + stiffness * np.eye(n)
    p = np.hstack([np.ones((n, 1)), src])
    m = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(m, np.vstack([dst, np.zeros((3, 2))]), rcond=None)[0]
    return w[:n], w[n:]


def spline_apply(model: tuple[np.ndarray, np.ndarray], src: np.ndarray, at: np.ndarray) -> np.ndarray:
    return spline_kernel(((at[:, None] - src[None]) ** 2).sum(2)) @ model[0] + np.hstack([np.ones((len(at), 1)), at]) @ model[1]


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of different points: each point in turn opens the triangles whose circle holds it and is tied to the hole's rim."""
    span = float(np.ptp(points, axis=0).max()) or 1.0
    mid = points.mean(0)
    pts = np.vstack([points, mid + span * np.array([[-30.0, -30.0], [30.0, -30.0], [0.0, 40.0]])])
    n = len(points)

    def circle(t: tuple[int, int, int]) -> tuple[tuple[int, int, int], np.ndarray, float]:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by)) or 1e-30
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        o = np.array([(a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d])
        return t, o, float(((pts[t[0]] - o) ** 2).sum())

    found = [circle((n, n + 1, n + 2))]
    for i in range(n):
        hit = [c for c in found if ((pts[i] - c[1]) ** 2).sum() < c[2] * (1 + 1e-12)]
        sides = [tuple(sorted((t[j], t[j - 1]))) for t, _, _ in hit for j in range(3)]
        rim = [s for s in sides if sides.count(s) == 1]
        gone = {t for t, _, _ in hit}
        found = [c for c in found if c[0] not in gone] + [circle((a, b, i)) for a, b in rim]
    return [t for t, _, _ in found if max(t) < n]


def piecewise_apply(src: np.ndarray, dst: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places mapped by the affine map of the triangle of src points that holds them; NaN outside all."""
    out = np.full(at.shape, np.nan)
    for t in triangles(src):
        m = np.vstack([src[list(t)].T, np.ones(3)])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        bary = np.linalg.solve(m, np.vstack([at.T, np.ones(len(at))]))
        inside = (bary >= -1e-9).all(0)
        out[inside] = (dst[list(t)].T @ bary[:, inside]).T
    return out


def landmark_warp(labels: DataFrame, pairs: DataFrame, keys: list[str], shape: tuple[int, int], method: str = "affine", stiffness: float = 0.0) -> DataFrame:
    """Label images laid over the real image by landmark pairs, nearest label, 0 outside.

    labels: y, x, region_id; pairs: atlas_x, atlas_y, real_x, real_y. Each real pixel asks the map from real to atlas places: affine (3 pairs at least), piecewise (4) or spline.
    An image with its pairs is one task's work; the output holds every pixel of shape.
    """
    least = {"affine": 3, "piecewise": 4, "spline": 3}[method]

    def run(key, left, right):
        if len(right) < least:
            raise ValueError(f"{method} needs {least} landmark pairs, {key} has {len(right)}")
        real, atlas = right[["real_x", "real_y"]].to_numpy(float), right[["atlas_x", "atlas_y"]].to_numpy(float)
        y, x = (a.ravel() for a in np.indices(shape))
        at = np.stack([x, y], 1).astype(float)
        if method == "affine":
            forward = np.linalg.lstsq(np.hstack([atlas, np.ones((len(atlas), 1))]), real, rcond=None)[0]
            src = (at - forward[2]) @ np.linalg.inv(forward[:2])
        elif method == "piecewise":
            src = piecewise_apply(real, atlas, at)
        else:
            src = spline_apply(spline_fit(real, atlas, stiffness), real, at)
        img = np.zeros((int(left["y"].max()) + 1, int(left["x"].max()) + 1), np.int64)
        img[left["y"], left["x"]] = left["region_id"]
        sx, sy = np.rint(np.nan_to_num(src, nan=-1.0)).astype(int).T
        ok = (sx >= 0) & (sy >= 0) & (sx < img.shape[1]) & (sy < img.shape[0])
        out = np.zeros(len(y), np.int32)
        out[ok] = img[sy[ok], sx[ok]]
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "y": y.astype(np.int32), "x": x.astype(np.int32), "region_id": out})

    pairs = pairs.select(*[F.col(c).alias(c) for c in [*keys, "atlas_x", "atlas_y", "real_x", "real_y"]])  # columns of its own, as both may come from one frame
    return labels.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInPandas(run, _schema(labels, keys, "y int, x int, region_id int"))


# ---- corners and robust models --------------------------------------------------------------------------------------

def corners(image: np.ndarray, most: int = 30, distance: int = 12, sigma: float = 1.0, k: float = 0.05) -> np.ndarray:
    """Corner places (x, y) by the determinant-less-trace response of the smoothed structure tensor, strongest first, `distance` apart."""
    gy, gx = np.gradient(image.astype(float))
    xx, yy, xy = smooth(gx * gx, sigma), smooth(gy * gy, sigma), smooth(gx * gy, sigma)
    r = xx * yy - xy * xy - k * (xx + yy) ** 2
    inner = np.zeros(r.shape, bool)
    inner[distance:-distance or None, distance:-distance or None] = True
    order = np.argsort(-np.where(inner, r, -np.inf), axis=None, kind="stable")
    found: list[tuple[int, int]] = []
    free = inner & (r > 0.1 * max(0.0, r.max()))
    for i in order:
        y, x = divmod(int(i), r.shape[1])
        if not free[y, x]:
            if not inner[y, x]:
                break
            continue
        found.append((x, y))
        if len(found) == most:
            break
        free[max(0, y - distance) : y + distance + 1, max(0, x - distance) : x + distance + 1] = False
    return np.array(found, float).reshape(-1, 2)


def robust_affine(src: np.ndarray, dst: np.ndarray, residual: float = 8.0, trials: int = 100, seed: int = 0) -> np.ndarray:
    """Which pairs agree with the affine map of the three pairs, of `trials` seeded draws, that most pairs agree with (M25); all where there are fewer than four."""
    n = len(src)
    best = np.ones(n, bool)
    if n < 4:
        return best
    r, score = np.random.default_rng(seed), (0, -np.inf)
    one = np.hstack([src, np.ones((n, 1))])
    for _ in range(trials):
        pick = r.choice(n, 3, replace=False)
        if abs(np.linalg.det(one[pick])) < 1e-9:
            continue
        off = np.sqrt(((one @ np.linalg.solve(one[pick], dst[pick]) - dst) ** 2).sum(1))
        ok = off < residual
        if (ok.sum(), -off[ok].sum()) > score:
            best, score = ok, (ok.sum(), -off[ok].sum())
    return best


def propose_landmarks(pixels: DataFrame, keys: list[str], *, most: int = 30, distance: int = 12, residual: float = 8.0) -> DataFrame:
    """real_x, real_y, atlas_x, atlas_y by image: corners of both images paired by strength, outliers of a robust affine map left out (M25). pixels: y, x, real, atlas."""

    def run(key, pdf):
        real, atlas = (corners(_grid(pdf, c)[0], most, distance) for c in ("real", "atlas"))
        n = min(len(real), len(atlas))
        ok = robust_affine(atlas[:n], real[:n], residual)
        real, atlas = real[:n][ok], atlas[:n][ok]
        return pd.DataFrame({**{k: [v] * len(real) for k, v in zip(keys, key, strict=True)}, "real_x": real[:, 0], "real_y": real[:, 1], "atlas_x": atlas[:, 0], "atlas_y": atlas[:, 1]})

    return pixels.groupBy(*keys).applyInPandas(run, _schema(pixels, keys, "real_x double, real_y double, atlas_x double, atlas_y double"))
