"""Label images and volumes as tall tables: building, tiling, histograms, coverage, shapes, peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import id_rgb
from .kernels import _grid, _schema, by_image
from .registration import otsu


def channel(pixels: DataFrame, values: str, index: int) -> DataFrame:
    """One channel of an array of channels, the first where it is out of range."""
    i = F.when(F.size(values) > index, F.lit(index + 1)).otherwise(1)
    return pixels.withColumn("value", F.element_at(F.col(values), i)).drop(values)


def extract_stack(stack: DataFrame, *, every: int = 1, z_min: int = 0, z_max: int = -1) -> DataFrame:
    """Slices z_min to z_max (inclusive; -1: the last) in steps."""
    ok = (F.col("z") >= z_min) & ((F.col("z") - z_min) % every == 0)
    return stack.where(ok & (F.col("z") <= z_max) if z_max >= 0 else ok)


def build_volume(stack: DataFrame, *, every: int, down: int, pad: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Strided and padded volume coordinates."""
    kept = stack.where((F.col("z") % every == 0) & (F.col("y") % down == 0) & (F.col("x") % down == 0))
    at = lambda c, n, p: (F.floor(F.col(c) / n) + p).cast("int")
    return kept.withColumns({"z": at("z", every, pad[0]), "y": at("y", down, pad[1]), "x": at("x", down, pad[2])})


def inspect(stack: DataFrame) -> DataFrame:
    """Extent of a volume."""
    return stack.agg(*[(F.max(c) + 1).cast("int").alias(n) for c, n in (("z", "n_slices"), ("y", "height"), ("x", "width"))], F.count("*").alias("voxels"))


def merge_slices(pixels: DataFrame, n: int = 5) -> DataFrame:
    """Mean image of every n slices, truncated to whole numbers."""
    return pixels.groupBy(F.floor(F.col("slice_id") / n).cast("int").alias("chunk"), "y", "x").agg(F.avg("value").cast("int").alias("value"))


def label_histogram(raster: DataFrame, least: int = 80) -> DataFrame:
    """Pixels of each label, outside left out, small ones left out."""
    return raster.where("region_id > 0").groupBy("slice_id", "region_id").agg(F.count("*").alias("pixels")).where(F.col("pixels") >= least)


def coverage(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of tissue with a label, by half about the tissue's middle column (G24). pixels: x, tissue, label."""
    mid = pixels.where("tissue").groupBy(*keys).agg(((F.min("x") + F.max("x")) / 2).alias("mid"))
    t = pixels.where("tissue").join(mid, keys)
    part = lambda c: F.coalesce(F.avg(F.when(c, (F.col("label") > 0).cast("double"))), F.lit(0.0))
    out = t.groupBy(*keys).agg(part(F.lit(True)).alias("coverage"), part(F.col("x") < F.col("mid")).alias("left_cov"), part(F.col("x") >= F.col("mid")).alias("right_cov"), F.count_if(F.col("label") <= 0).alias("missing_px"))
    return out.withColumns({"gap": F.abs(F.col("left_cov") - F.col("right_cov")), "min_lr": F.least("left_cov", "right_cov")})


def shapes(pixels: DataFrame, keys: list[str], intensity: str | None = None) -> DataFrame:
    """Area, centroid, box, axes, elongation and score of each label (G26, G27). Axes: 4 sqrt of the covariance's eigenvalues, with 1/12 for a pixel's own extent."""
    aggs = [F.count("*").alias("area_px"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy")]
    s = pixels.groupBy(*keys).agg(*aggs, *([F.avg(intensity).alias("mean_intensity")] if intensity else []))
    a, b = F.col("vx") + 1 / 12, F.col("vy") + 1 / 12
    half, root = (a + b) / 2, F.sqrt(((a - b) / 2) ** 2 + F.col("vxy") ** 2)
    s = s.withColumns({"major": 4 * F.sqrt(half + root), "minor": 4 * F.sqrt(F.greatest(half - root, F.lit(0.0)))})
    return s.withColumns({"elongation": F.least(F.greatest(F.col("minor") / F.col("major"), F.lit(0.0)), F.lit(1.0)), "score": F.sqrt("area_px")}).drop("vx", "vy", "vxy")


def staining_by(voxels: DataFrame, keys: list[str], min_signal: float = 0.02, least: int = 16) -> DataFrame:
    """Atlas, covered and positive voxels with their shares, Otsu threshold and mean signal by key (G25). voxels: annotation, signal (normalised).

    Covered voxels are labelled ones with a signal above min_signal; positive ones reach Otsu's threshold of the covered signal. With `least` covered voxels or fewer there is no threshold and
    nothing is positive; without atlas voxels all is 0. A signal that is the same everywhere is its own threshold.
    """
    v = voxels.withColumn("_key", F.lit(0))
    keys = ["_key", *keys]
    atlas, covered = F.col("annotation") > 0, (F.col("annotation") > 0) & (F.col("signal") > min_signal)
    inside = v.where(covered)
    flat = inside.groupBy(*keys).agg(F.min("signal").alias("_lo"), F.max("signal").alias("_hi"), F.count("*").alias("_n"))
    cut = flat.join(otsu(inside, keys, "signal"), keys, "left").select(*keys, F.when(F.col("_n") > least, F.coalesce("threshold", "_lo")).alias("_t"))
    n = lambda c: F.count_if(c)
    s = v.join(cut, keys, "left").groupBy(*keys).agg(n(atlas).alias("atlas_voxels"), n(covered).alias("covered_voxels"), n(covered & (F.col("signal") >= F.col("_t"))).alias("positive_voxels"), F.coalesce(F.avg(F.when(covered, F.col("signal"))), F.lit(0.0)).alias("mean_signal"), F.coalesce(F.max("_t"), F.lit(0.0)).alias("signal_threshold"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.withColumns({"coverage": share("covered_voxels", "atlas_voxels"), "staining_rate": share("positive_voxels", "covered_voxels"), "positive_fraction_of_atlas": share("positive_voxels", "atlas_voxels")}).drop("_key")


def staining(voxels: DataFrame, min_signal: float = 0.02) -> DataFrame:
    """staining_by of all voxels as one row."""
    return staining_by(voxels, [], min_signal)


def peaks(pixels: DataFrame, keys: list[str], *, distance: int = 8, threshold: float = 200.0) -> DataFrame:
    """Pixels that are the largest of their (2d+1)^2 square and above a threshold (M17): a running maximum along x, then y, over full rows and columns."""
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-distance, distance)
    col = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-distance, distance)
    m = pixels.withColumn("_r", F.max("value").over(row)).withColumn("_m", F.max("_r").over(col))
    return m.where((F.col("value") == F.col("_m")) & (F.col("value") > threshold)).drop("_r", "_m")


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles in steps of tile - overlap, the last one flush with the end."""
    last = F.greatest(length - tile, F.lit(0))
    return F.array_sort(F.array_distinct(F.array_union(F.sequence(F.lit(0), last, F.lit(max(1, tile - overlap))), F.array(last))))


def mode3(raster: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent label of each 3 x 3 neighbourhood of full images, the smallest on a tie."""

    def run(key, pdf):
        pdf = pdf.dropna()
        y, x = (pdf[c].to_numpy() - (pdf[c].min() if len(pdf) else 0) for c in "yx")
        shape = (int(y.max(initial=0)) + 1, int(x.max(initial=0)) + 1)
        label, there = np.zeros((shape[0] + 2, shape[1] + 2), np.int64), np.zeros((shape[0] + 2, shape[1] + 2), bool)
        label[y + 1, x + 1], there[y + 1, x + 1] = pdf["region_id"].to_numpy(np.int64), True
        at = [(slice(i, i + shape[0]), slice(j, j + shape[1])) for i in range(3) for j in range(3)]
        best, most = np.zeros(shape, np.int64), np.zeros(shape, np.int8)
        for a in at:
            votes = sum(((label[a] == label[b]) & there[b]).astype(np.int8) for b in at) * there[a]
            more = (votes > most) | ((votes == most) & (votes > 0) & (label[a] < best))
            best, most = np.where(more, label[a], best), np.where(more, votes, most)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "y": pdf["y"], "x": pdf["x"], "mode": best[y, x]})

    label = raster.schema["region_id"].dataType.simpleString()
    return by_image(raster.select(*keys, "y", "x", "region_id"), keys, run, _schema(raster, keys, f"y int, x int, mode {label}"))


def centre(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Pads or crops about the centre."""
    dy, dx = (target[0] - size[0]) // 2, (target[1] - size[1]) // 2
    return pixels.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx}).where(F.col("y").between(0, target[0] - 1) & F.col("x").between(0, target[1] - 1))


def blend(base: Column, color: Column, mask: Column, alpha: float) -> Column:
    """Alpha blend where the mask holds, truncated."""
    return F.when(mask, (base * (1 - alpha) + color * alpha).cast("int")).otherwise(base)


def colorize(raster: DataFrame, colors: DataFrame) -> DataFrame:
    """Each labelled pixel's colour: that of the map, else that of its id; outside is black (M30). colors: region_id, r, g, b."""
    own = raster.join(colors, "region_id", "left")
    fallback = id_rgb(F.col("region_id"))
    return own.withColumns({c: F.when(F.col("region_id") <= 0, 0).otherwise(F.coalesce(F.col(c), fallback[c])) for c in "rgb"})


def outlined(raster: DataFrame, keys: list[str], color: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Coloured full images with the boundaries between labels and to the outside painted over (M30): pixels whose right or lower neighbour has another label, and those neighbours. raster: y, x, region_id, r, g, b."""

    def run(key, pdf):
        label, y0, x0 = _grid(pdf, "region_id", np.nan)
        line = np.zeros(label.shape, bool)
        for axis in (0, 1):
            a, b = (np.moveaxis(label, axis, 0)[s] for s in (slice(None, -1), slice(1, None)))
            differs = (a != b) & ~np.isnan(a) & ~np.isnan(b)
            for s in (slice(None, -1), slice(1, None)):
                np.moveaxis(line, axis, 0)[s] |= differs
        on = (line & (label > 0))[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0]
        return pdf.assign(**dict(zip(keys, key, strict=True)), **{c: pdf[c].mask(on, v) for c, v in zip("rgb", color, strict=True)})

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raster.schema if f.name not in keys)
    return by_image(raster, keys, run, _schema(raster, keys, rest)).select(*raster.columns)


def gamma(value: Column, g: float) -> Column:
    """255 (v/255)^g, g in 0.2 to 3, truncated."""
    g = min(3.0, max(0.2, g))
    return (255 * F.pow(value / 255.0, F.lit(g))).cast("int")


def slice_area(volume: DataFrame) -> DataFrame:
    """Labelled voxels of each plane."""
    return volume.groupBy("z").agg(F.count_if(F.col("annotation") > 0).alias("area"))


def synthetic_slices(spark: SparkSession, n: int = 12, height: int = 64, width: int = 64) -> DataFrame:
    """Seeded noise with bright spots as tall slices (S19): arithmetic on the pixel number only."""
    df = spark.range(n * height * width).selectExpr(f"cast(id div {height * width} as int) slice_id", f"cast(id % {height * width} div {width} as int) y", f"cast(id % {width} as int) x", "id")
    return df.selectExpr("slice_id", "y", "x", "cast((id * 1103515245 + 12345) % 2147483648 div 65536 % 120 + case when x % 16 = 8 and y % 16 = 8 then 400 + slice_id else 0 end as int) value")
