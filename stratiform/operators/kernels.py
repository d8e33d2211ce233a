"""Array kernels of images: numpy on one image at a time where built-in expressions don't do.

An image (one slice) is the unit of work and fits a task; images spread over the cluster by their key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _grid(pdf: pd.DataFrame, value: str, fill=0.0) -> tuple[np.ndarray, int, int]:
    """Dense image of tall pixels, and its origin."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    out = np.full((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), fill, dtype=float)
    out[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[value].to_numpy(dtype=float)
    return out, y0, x0


def _tall(keys: list[str], key: tuple, y, x, **cols) -> pd.DataFrame:
    return pd.DataFrame({**dict(zip(keys, key, strict=True)), "y": np.asarray(y, np.int32), "x": np.asarray(x, np.int32), **cols})


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + rest


def by_image(pixels: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(key, frame of the other columns) for each image, as applyInPandas does it.

    Pixels of an image that come together travel as one row, their columns as bytes: rows that stand for thousands of pixels are all that is sorted and sent, and
    runs of labels and places compress. Images are spread by their number and not by bytes, as kernels take their time whatever an image packs to.
    """
    values = [c for c in pixels.columns if c not in keys]

    def pack(batches):
        for b in batches:
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                one = pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                code = code * (int(one.max(initial=0)) + 1) + one
            if (code[1:] < code[:-1]).any():
                order = np.argsort(code, kind="stable")
                b, code = b.take(pa.array(order)), code[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            contents, rest = [], b.select(values)
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as stream:
                    stream.write_batch(rest.slice(i, j - i))
                contents.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(starts)) for k in keys), pa.array(contents, pa.binary())], names=[*keys, "_pixels"])

    def image(key, packed):
        return run(key, pa.concat_tables([pa.ipc.open_stream(c).read_all() for c in packed["_pixels"]]).to_pandas())

    spark = pixels.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    runs = pixels.select(*keys, *values).mapInArrow(pack, _schema(pixels, keys, "_pixels binary"))
    return runs.repartition(parts, *keys).groupBy(*keys).applyInPandas(image, schema)


def ssim(pairs: DataFrame, keys: list[str], window: int = 7, span: float = 1.0) -> DataFrame:
    """Mean structural similarity of full images a and b over windows that fit, sample covariances (M06): running sums along rows, then columns. An image smaller than the window scores 0."""
    c1, c2, n = (0.01 * span) ** 2, (0.03 * span) ** 2, window * window
    rows = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(0, window - 1)
    cols = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(0, window - 1)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    sums = {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b, "n": F.lit(1)}
    p = pairs.select(*keys, "y", "x", *[v.alias(k) for k, v in sums.items()])
    for over in (rows, cols):
        p = p.select(*keys, "y", "x", *[F.sum(k).over(over).alias(k) for k in sums])
    ma, mb = F.col("sa") / n, F.col("sb") / n
    va, vb, cab = ((F.col(s) - n * m) / (n - 1) for s, m in (("saa", ma * ma), ("sbb", mb * mb), ("sab", ma * mb)))
    s = (2 * ma * mb + c1) * (2 * cab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return p.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("n") == n, s)), F.lit(0.0)).alias("ssim"))


def _near(mask: np.ndarray, tol: int) -> np.ndarray:
    """Pixels with a set one within `tol` along both axes, by running sums."""
    for axis in (0, 1):
        n = mask.shape[axis]
        sums = np.pad(mask.astype(np.int64).cumsum(axis), [(1, 0) if i == axis else (0, 0) for i in (0, 1)])
        at = np.arange(n)
        mask = np.take(sums, np.minimum(at + tol + 1, n), axis) > np.take(sums, np.maximum(at - tol, 0), axis)
    return mask


def boundary_f1(pred: DataFrame, target: DataFrame, keys: list[str], tol: int = 2) -> DataFrame:
    """Precision, recall and F1 of each image's boundaries within a tolerance (M08). An image without a boundary on one side scores 0 there.

    pred, target: y, x, v of the same full images. Boundary pixels have another value to the right or below; they are dilated along both axes by running sums, whatever the tolerance.
    """

    def edges(a: np.ndarray) -> np.ndarray:
        out = np.zeros(a.shape, bool)
        here, right, below = a[:-1, :-1], a[:-1, 1:], a[1:, :-1]
        out[:-1, :-1] = ~np.isnan(here) & ~np.isnan(right) & ~np.isnan(below) & ((here != right) | (here != below))
        return out

    def run(key, pdf):
        pdf = pdf.assign(y=pdf["y"] - pdf["y"].min(), x=pdf["x"] - pdf["x"].min())
        shape = (int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1)
        found = []
        for side in (False, True):
            p, a = pdf[pdf["_target"] == side], np.full(shape, np.nan)
            if p.empty:
                return pd.DataFrame({c: [] for c in [*keys, "precision", "recall"]})
            v = p["v"]
            if v.dtype == object:  # text, decimals: by their numbers
                v = pd.Series(pd.factorize(v)[0]).replace(-1, np.nan)
            a[p["y"].to_numpy(), p["x"].to_numpy()] = v.to_numpy(float)
            found.append(edges(a))
        share = [float(_near(g, tol)[e].mean()) if e.any() else 0.0 for e, g in (found, found[::-1])]
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "precision": share[0], "recall": share[1]}])

    both = pred.select(*keys, "y", "x", "v", F.lit(False).alias("_target")).union(target.select(*keys, "y", "x", "v", F.lit(True).alias("_target")))
    out = by_image(both, keys, run, _schema(pred, keys, "precision double, recall double"))
    r, q = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(r + q > 0, 2 * r * q / (r + q)).otherwise(0.0))


def label_components(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Components of equal non-zero values that touch at sides, or at corners too; numbers are the smallest flat index plus one.

    Runs along rows are joined, not pixels: each takes the lowest number of the runs that it touches until none changes.
    """
    h, w = mask.shape
    new = np.ones((h, w), bool)
    new[:, 1:] = mask[:, 1:] != mask[:, :-1]
    starts, run = np.flatnonzero(new), (np.cumsum(new) - 1).reshape(h, w)
    up, low = [], []
    for shift in (-1, 0, 1) if corners else (0,):
        a, b = slice(max(0, -shift), w - max(0, shift)), slice(max(0, shift), w - max(0, -shift))
        same = (mask[:-1, a] == mask[1:, b]) & (mask[:-1, a] != 0)
        up.append(run[:-1, a][same])
        low.append(run[1:, b][same])
    up, low = np.concatenate(up), np.concatenate(low)
    once = np.ones(len(up), bool)
    once[1:] = (up[1:] != up[:-1]) | (low[1:] != low[:-1])
    up, low, root = up[once], low[once], np.arange(len(starts))
    while True:
        a, b = root[up], root[low]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # jump to the root's own root
            far = root[root]
            if (far == root).all():
                break
            root = far
    return np.where(mask != 0, starts[root][run] + 1, 0)


def connected_components(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """component of each pixel, 4-connected."""

    def run(key, pdf):
        lab = label_components(_grid(pdf.assign(one=1.0), "one")[0])
        y, x = pdf["y"] - pdf["y"].min(), pdf["x"] - pdf["x"].min()
        return _tall(keys, key, pdf["y"], pdf["x"], component=lab[y, x].astype(np.int64))

    return by_image(pixels, keys, run, _schema(pixels, keys, "y int, x int, component long"))


def remove_islands(raster: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Label islands of fewer than `least` pixels take the label most frequent among their neighbours outside the island."""

    def run(key, pdf):
        lab, y0, x0 = _grid(pdf, "region_id")
        lab = lab.astype(np.int64)
        comp = label_components(lab + 1)
        ids, counts = np.unique(comp, return_counts=True)
        for c in ids[counts < least]:
            m = comp == c
            ring = np.zeros_like(m)
            ring[1:] |= m[:-1]
            ring[:-1] |= m[1:]
            ring[:, 1:] |= m[:, :-1]
            ring[:, :-1] |= m[:, 1:]
            around = lab[ring & ~m]
            if len(around):
                v, k = np.unique(around, return_counts=True)
                lab[m] = v[k.argmax()]
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return _tall(keys, key, y, x, region_id=lab[y - y0, x - x0].astype(np.int32))

    return by_image(raster, keys, run, _schema(raster, keys, "y int, x int, region_id int"))


def gradient(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Central-difference gradient length of inner pixels of full images (M15): neighbours along rows and columns by window."""
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    j = pixels.withColumns({"gx": F.lead("value").over(row) - F.lag("value").over(row), "gy": F.lead("value").over(col) - F.lag("value").over(col)})
    return j.where("gx is not null and gy is not null").select(*keys, "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("g"))


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter, edges repeated. Sums in one order, so that a pixel's value doesn't depend on where the array begins."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        wide = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], "edge")
        a = sum(w * np.take(wide, np.arange(i, i + n), axis) for i, w in enumerate(k))
    return a


def blob_scores(a: np.ndarray, low: float, high: float, steps: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Maxima over space and scale of the scaled negative Laplacian of Gaussian of an image in 0 to 1: scale number, y, x and score, and the scales."""
    sig = np.linspace(low, high, steps)
    cube = []
    for s in sig:
        g = np.pad(smooth(a, s), 1, "edge")
        cube.append(-(g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1]) * s * s)
    c = np.pad(np.array(cube), 1, constant_values=-np.inf)
    top = np.max([c[1 + i : c.shape[0] - 1 + i, 1 + j : c.shape[1] - 1 + j, 1 + k : c.shape[2] - 1 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], axis=0)
    inner = c[1:-1, 1:-1, 1:-1]
    i, y, x = np.nonzero((inner == top) & (inner > threshold))
    return i, y, x, inner[i, y, x], sig


def log_blobs(pixels: DataFrame, keys: list[str], *, low: float = 1.2, high: float = 5.0, steps: int = 8, threshold: float = 0.03) -> DataFrame:
    """Blobs as maxima over space and scale of the scaled negative Laplacian of Gaussian."""

    def run(key, pdf):
        a, y0, x0 = _grid(pdf, "value")
        i, y, x, score, sig = blob_scores((a - a.min()) / max(1e-9, a.max() - a.min()), low, high, steps, threshold)
        return _tall(keys, key, y + y0, x + x0, sigma=sig[i], area_px=np.pi * 2 * sig[i] ** 2, score=score)

    return by_image(pixels, keys, run, _schema(pixels, keys, "y int, x int, sigma double, area_px double, score double"))


def clip_flow(flow: DataFrame, most: float) -> DataFrame:
    """Displacements no longer than `most`."""
    k = F.least(F.lit(1.0), most / F.greatest(F.sqrt(F.col("v") ** 2 + F.col("u") ** 2), F.lit(1e-9)))
    return flow.withColumns({"v": F.col("v") * k, "u": F.col("u") * k})


def warp_nearest(raster: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """Labels fetched from displaced places, nearest pixel, 0 outside (M22): a gather join."""
    src = flow.select(*keys, "y", "x", F.rint(F.col("y") + F.col("v")).cast("int").alias("sy"), F.rint(F.col("x") + F.col("u")).cast("int").alias("sx"))
    lab = raster.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), "region_id")
    return src.join(lab, [*keys, "sy", "sx"], "left").select(*keys, "y", "x", F.coalesce("region_id", F.lit(0)).alias("region_id"))


def laplace_fields(known: np.ndarray, value: np.ndarray, rtol: float, most: int) -> np.ndarray:
    """Harmonic fields through known values, edges free, of many planes [plane, y, x] at once; a plane that is done rests."""

    def apply(f: np.ndarray) -> np.ndarray:
        out = np.zeros_like(f)
        for head, tail in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :, 1:], np.s_[:, :, :-1])):
            d = f[head] - f[tail]
            out[tail] -= d
            out[head] += d
        return out

    deg = np.full(known.shape[1:], 4.0)
    deg[[0, -1]] -= 1
    deg[:, [0, -1]] -= 1
    dot = lambda a, b: (a * b).sum((1, 2), keepdims=True)
    free, out = ~known, value.copy()
    rhs = np.where(free, -apply(value), 0)
    r, at = rhs.copy(), np.arange(len(value))
    f, z = np.zeros_like(r), r / deg
    p, rz, stop = z.copy(), dot(r, z), rtol * np.maximum(1e-30, np.sqrt(dot(rhs, rhs)))
    for turn in range(most + 1):
        on = (np.sqrt(dot(r, r)) > stop).ravel() & (turn < most)
        if not on.all():
            out[at[~on]] = np.where(free[~on], f[~on], value[at[~on]])
            at, free, f, r, p, rz, stop = (a[on] for a in (at, free, f, r, p, rz, stop))
        if not len(at):
            break
        ap = np.where(free, apply(p), 0)
        alpha = rz / dot(p, ap)
        f, r = f + alpha * p, r - alpha * ap
        z = r / deg
        new = dot(r, z)
        p, rz = z + new / rz * p, new
    return out


PLANES = 512  # planes solved at once, for 16 x 16 pixels; fewer of larger ones


def laplace_field(fixed: DataFrame, keys: list[str], shape: tuple[int, int], rtol: float = 1e-8, most: int = 2000) -> DataFrame:
    """The harmonic field through fixed values, edges free, by preconditioned conjugate gradients (M23). Some planes share a call."""
    y, x = (a.ravel().astype(np.int32) for a in np.indices(shape))
    some, pixels = max(1, PLANES * 256 // len(y)), len(y)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, some):
                part = b.slice(i, min(some, b.num_rows - i))
                points = part.column("_points")
                plane = np.repeat(np.arange(part.num_rows), pc.list_value_length(points).to_numpy(zero_copy_only=False))
                flat = points.flatten()
                py, px, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
                known, value = np.zeros((part.num_rows, *shape), bool), np.zeros((part.num_rows, *shape))
                known[plane, py, px], value[plane, py, px] = True, v
                out = laplace_fields(known, value, rtol, most)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(np.repeat(np.arange(n), pixels))) for k in keys), pa.array(np.tile(y, n)), pa.array(np.tile(x, n)), pa.array(np.round(out.ravel(), 5))], names=[*keys, "y", "x", "value"])

    planes = fixed.groupBy(*keys).agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("v"))).alias("_points"))
    return planes.mapInArrow(run, _schema(fixed, keys, "y int, x int, value double"))


def normals(points: DataFrame, keys: list[str]) -> DataFrame:
    """Normal of a neighbourhood: the short axis of its covariance, in closed form."""
    s = points.groupBy(*keys).agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    t = 0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))
    return s.select(*keys, (-F.sin(t)).alias("nx"), F.cos(t).alias("ny"))


def nelder_mead(f, start: np.ndarray, step: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Downhill simplex."""
    pts = np.vstack([start, start + np.diag(step)])
    val = np.array([f(p) for p in pts])
    for _ in range(rounds):
        o = np.argsort(val, kind="stable")
        pts, val = pts[o], val[o]
        mid = pts[:-1].mean(0)
        tries = {c: mid + c * (mid - pts[-1]) for c in (1.0, 2.0, 0.5, -0.5)}
        one = f(tries[1.0])
        if one < val[0]:
            two = f(tries[2.0])
            new = (tries[2.0], two) if two < one else (tries[1.0], one)
        elif one < val[-2]:
            new = (tries[1.0], one)
        else:
            c = 0.5 if one < val[-1] else -0.5
            v = f(tries[c])
            if v >= min(one, val[-1]):
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
                continue
            new = (tries[c], v)
        pts[-1], val[-1] = new
    i = val.argmin()
    return pts[i], float(val[i])
