"""Whole-slide images by tiles, so that no task holds an image: components across seams, blobs with halos, detections merged over overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Tables
from .graph import least_members
from .kernels import _schema, blob_scores, label_components

_SHIFT = 31  # a component is named by its first pixel: y * 2^31 + x


def _named(y, x):
    return (np.asarray(y, np.int64) << _SHIFT) + np.asarray(x, np.int64)


def tiled_components(pixels: DataFrame, keys: list[str], value: str | None = None, tile: int = 512) -> DataFrame:
    """keys, y, x, component of each pixel: 4-connected pixels of equal value (of any, if there is no value), named by the first of them, y * 2^31 + x.

    Labels are made within tiles; only pixels at seams meet over them, and only labels that touch a seam change.
    """
    value_of = F.col(value) if value else F.lit(1)
    p = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value_of.cast("long").alias("_v"))
    p = p.withColumns({"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")})

    def run(key, pdf):
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        _, number = np.unique(pdf["_v"].to_numpy(), return_inverse=True)
        a = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), np.int64)
        a[y - y0, x - x0] = number + 1
        first = label_components(a)[y - y0, x - x0] - 1
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "y": y, "x": x, "_v": pdf["_v"].to_numpy(), "label": _named(first // a.shape[1] + y0, first % a.shape[1] + x0)})

    labels = p.groupBy(*keys, "_ty", "_tx").applyInPandas(run, _schema(pixels, keys, "y int, x int, _v long, label long"))
    links = None
    for axis in ("y", "x"):
        before = labels.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).withColumn(axis, F.col(axis) + 1).withColumnRenamed("label", "a")
        after = labels.where(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumnRenamed("label", "b")
        met = before.join(after, [*keys, "y", "x", "_v"]).select(*keys, "a", "b").distinct()
        links = met if links is None else links.unionByName(met)
    least = least_members(links, keys).withColumnRenamed("node", "label")
    return labels.join(least.hint("merge"), [*keys, "label"], "left").select(*keys, "y", "x", F.coalesce("least", "label").alias("component"))


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """pixels in each tile (_ty, _tx) that they lie in or within `halo` pixels of."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return pixels.withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x")))


def tiled_blobs(pixels: DataFrame, keys: list[str], *, low: float = 1.2, high: float = 5.0, steps: int = 8, threshold: float = 0.03, tile: int = 512) -> DataFrame:
    """The blobs of kernels.log_blobs, by tiles with as many halo pixels as the widest filter reaches (M16, M17): the same for any tile size.

    An image's range and edges are added up beforehand; missing pixels within them are 0, as there.
    """
    reach = int(4 * high + 0.5) + 2  # the filter, its second difference and the comparison with neighbours
    p = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    box = p.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}{c}") for c in ("y", "x", "value") for n, f in (("low", F.min), ("high", F.max))])
    full = F.col("_n") == (F.col("_highy") - F.col("_lowy") + 1) * (F.col("_highx") - F.col("_lowx") + 1)
    zero: Column = F.lit(0.0)  # a missing pixel's value takes part in the range
    box = box.withColumns({"_lowvalue": F.when(full, F.col("_lowvalue")).otherwise(F.least("_lowvalue", zero)), "_highvalue": F.when(full, F.col("_highvalue")).otherwise(F.greatest("_highvalue", zero))}).drop("_n")
    tiled = with_halo(p, tile, reach).join(box, keys)  # one row an image

    def run(key, pdf):
        ty, tx = key[-2:]
        y0, y1, x0, x1, least, most = (pdf[c].iloc[0] for c in ("_lowy", "_highy", "_lowx", "_highx", "_lowvalue", "_highvalue"))
        top, left = max(y0, ty * tile - reach), max(x0, tx * tile - reach)
        a = np.zeros((min(y1, (ty + 1) * tile - 1 + reach) - top + 1, min(x1, (tx + 1) * tile - 1 + reach) - left + 1))
        a[pdf["y"] - top, pdf["x"] - left] = pdf["value"]
        i, y, x, score, sig = blob_scores((a - least) / max(1e-9, most - least), low, high, steps, threshold)
        y, x = y + top, x + left
        own = (y // tile == ty) & (x // tile == tx)
        i, y, x, score = i[own], y[own], x[own], score[own]
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "y": y.astype(np.int32), "x": x.astype(np.int32), "sigma": sig[i], "area_px": np.pi * 2 * sig[i] ** 2, "score": score})

    return tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(run, _schema(pixels, keys, "y int, x int, sigma double, area_px double, score double"))


def one_of_each_cell(masks: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """keys, tile, cell, area, parts: one detection of each cell that overlapping tiles found more than once.

    masks: keys, tile, cell, y, x: the pixels of each tile's detections, in the image's coordinates. Detections of different tiles are the same cell where the pixels that both
    have are `share` of the smaller one's or more; of those that hang together so the largest stays (of equal ones the first by tile and cell), and parts says how many there were.
    A detection's pixels meet as words of 16 bits, one for 16 pixels of a row, which are added up before they are shuffled. A word lies in as many tiles as overlap there, so the pairs
    that meet grow with the words. No join broadcasts a side: its size is guessed by its file, which says little where cells were exploded into pixels.
    """
    tables = Tables(masks.sparkSession)
    bit = F.expr("shiftleft(1, cast(pmod(x, 16) as int))")
    m = masks.select(*keys, F.col("tile").cast("long").alias("tile"), F.col("cell").cast("long").alias("cell"), "y", F.floor(F.col("x") / 16).alias("_w"), bit.alias("_bits"))
    words = m.groupBy(*keys, "tile", "cell", "y", "_w").agg(F.bit_or("_bits").alias("_bits"))
    named = lambda c, p="": F.struct(F.col(f"{p}tile").alias("tile"), F.col(f"{p}cell").alias("cell")).alias(c)
    area = words.groupBy(*keys, "tile", "cell").agg(F.sum(F.bit_count("_bits")).alias("area"))
    area = tables.save(area.select(*keys, named("d"), "area"))
    others = words.select(*keys, "y", "_w", *[F.col(c).alias(f"_b_{c}") for c in ("tile", "cell", "_bits")])
    common = F.bit_count(F.col("_bits").bitwiseAND(F.col("_b__bits")))
    met = words.join(others.hint("merge"), [*keys, "y", "_w"]).where((F.col("tile") < F.col("_b_tile")) & (common > 0))
    both = met.groupBy(*keys, "tile", "cell", "_b_tile", "_b_cell").agg(F.sum(common).alias("_both")).select(*keys, named("a"), named("b", "_b_"), "_both")
    sized = both.join(area.select(*keys, F.col("d").alias("a"), F.col("area").alias("_na")).hint("merge"), [*keys, "a"]).join(area.select(*keys, F.col("d").alias("b"), F.col("area").alias("_nb")).hint("merge"), [*keys, "b"])
    same = sized.where(F.col("_both") >= share * F.least("_na", "_nb")).select(*keys, "a", "b")
    least = least_members(same, keys)
    known = area.join(least.withColumnRenamed("node", "d").hint("merge"), [*keys, "d"], "left").withColumn("_of", F.coalesce("least", "d"))
    best = known.groupBy(*keys, "_of").agg(F.min(F.struct((-F.col("area")).alias("area"), "d")).alias("b"), F.count("*").alias("parts"))
    return best.select(*keys, "b.d.tile", "b.d.cell", (-F.col("b.area")).alias("area"), "parts")
