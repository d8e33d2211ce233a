"""Drags that push a label image about (R18): an ordered fold of strokes into one displacement field, with undo by replay; and the matte of the tissue.

A stroke pulls what is around its start towards its end, with a Gaussian weight. `composed_field` carries each pixel through the strokes, the last one first, so that one fetch of the
label equals one fetch after another; weights are taken at the real places on the way, so nothing is interpolated. `summed_field` adds all strokes up
at the pixel itself, smooths and bounds the sum. A stroke is a few numbers, and an image's strokes, made by hand, travel as one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import gaussian
from .kernels import _grid, _schema, _tall
from .tiles import tiled_components

# Bounds of a stroke, its width and reach by its radius, and of the summed field.
RADIUS, STRENGTH, SHORTEST = (8.0, 260.0, 80.0), (0.05, 1.5, 0.72), 0.75
WIDTH_SHARE, WIDTH_LEAST, REACH_SHARE = 0.46, 4.0, 1.65
BAND, TOGETHER = 64, 1 << 14  # rows of an image that travel together; pixels or strokes of images that are worked on together
_STROKE = ("x1", "y1", "x2", "y2", "radius", "strength")
BLUR, MOST_PERCENTILE, MOST_SHARE, MOST_LEAST = 1.0, 99.5, 0.11, 6.0


def live_strokes(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys, strokes: what a log of strokes and undos leaves, in order: an undo takes back the last stroke that still holds, one with nothing before it does nothing.

    log: keys, order, kind (drag, undo), x1, y1, x2, y2, radius, strength. Strokes without an end or start or shorter than a pixel or so count for nothing, but can be taken back.
    """
    held = lambda c, b: F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(b[2])), F.lit(b[0])), F.lit(b[1]))
    one = F.struct(F.col(order).alias("seq"), F.col("kind"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], held("radius", RADIUS).alias("radius"), held("strength", STRENGTH).alias("strength"))
    # how many hold after each row: the sum of all steps, lifted by the undos that found nothing; a stroke goes when fewer hold later than those up to it
    w = Window.partitionBy(*keys).orderBy("_stroke")
    past, later = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    undo = F.coalesce(F.col("_stroke.kind") == "undo", F.lit(False))
    every = log.select(*keys, one.alias("_stroke")).withColumns({"_at": F.row_number().over(w), "_sum": F.sum(F.when(undo, -1).otherwise(1)).over(past)})
    every = every.withColumn("_held", F.col("_sum") - F.least(F.min("_sum").over(past), F.lit(0)))
    every = every.withColumn("_later", F.coalesce(F.min("_held").over(later), F.col("_held")))
    long = F.coalesce(F.hypot(F.col("_stroke.x2") - F.col("_stroke.x1"), F.col("_stroke.y2") - F.col("_stroke.y1")) >= SHORTEST, F.lit(False))
    live = ~undo & (F.col("_later") >= F.col("_held")) & long
    return every.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(live, F.col("_stroke")))).alias("strokes"))


def weight(y: Column, x: Column, s: Column, inside: Column | None = None) -> Column:
    """How much of a stroke's pull is felt at a place."""
    width, reach = F.greatest(F.lit(WIDTH_LEAST), WIDTH_SHARE * s["radius"]), REACH_SHARE * s["radius"]
    dy, dx = y - s["y1"], x - s["x1"]
    w = F.when((F.abs(dy) <= reach) & (F.abs(dx) <= reach), s["strength"] * F.exp(-0.5 * (dy * dy + dx * dx) / (width * width))).otherwise(0.0)
    return w if inside is None else F.when(inside, w).otherwise(0.0)


def composed_field(pixels: DataFrame, strokes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v, u: where each pixel fetches its label from, all strokes of its image one after another. Pixels may be exploded from a small file and are never broadcast."""
    # an image's pixels travel as arrays, in bands of rows
    packed = pixels.groupBy(*keys, F.floor(F.col("y") / BAND).alias("_band")).agg(F.collect_list(F.struct("y", "x")).alias("_at"))
    numbers = [F.col(f"strokes.{c}").cast("array<double>").alias(f"_{c}") for c in _STROKE]
    met = packed.join(strokes.select(*keys, *numbers).hint("merge"), keys).select(*keys, "_at", *[f"_{c}" for c in _STROKE])

    def carry(batches):
        for b in batches:
            pixels_of, strokes_of = (pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False) for c in ("_at", "_x1"))
            for some in _alike(pixels_of, strokes_of):
                images = b.take(pa.array(some))
                at, there = images.column("_at").flatten(), _places(pixels_of[some])
                y0, x0 = (_filled(at.field(k), there) for k in (0, 1))
                drawn = _places(strokes_of[some])
                y, x = _carried(y0, x0, *(_filled(images.column(f"_{c}").flatten(), drawn) for c in _STROKE))
                of = pa.array(np.repeat(np.arange(len(some)), pixels_of[some]))
                yield pa.RecordBatch.from_arrays([*(images.column(k).take(of) for k in keys), at.field(0), at.field(1), pa.array((y - y0)[there]), pa.array((x - x0)[there])], names=[*keys, "y", "x", "v", "u"])

    types = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("y", "x"))
    return met.mapInArrow(carry, _schema(pixels, keys, f"{types}, v double, u double"))


def _alike(pixels: np.ndarray, strokes: np.ndarray):
    """Numbers of images that are worked on together, those with about as many strokes: one at least, and else of so many pixels and strokes in all."""
    some, most, longest = [], 0, 0
    for i in np.lexsort((pixels, strokes)):
        most, longest = max(most, pixels[i]), max(longest, strokes[i])
        if some and (len(some) + 1) * max(most, longest) > TOGETHER:
            yield some
            some, most, longest = [], pixels[i], strokes[i]
        some.append(i)
    if some:
        yield some


def _places(lengths: np.ndarray) -> np.ndarray:
    """[image, place]: whether the image has so many."""
    return np.arange(lengths.max(initial=0)) < lengths[:, None]


def _filled(flat: pa.Array, there: np.ndarray) -> np.ndarray:
    """Values one image after another as rows of an array, with zeros behind: a stroke of zeros moves nothing."""
    out = np.zeros(there.shape)
    out[there] = flat.to_numpy(zero_copy_only=False)
    return out


def _carried(y: np.ndarray, x: np.ndarray, x1, y1, x2, y2, radius, strength) -> tuple[np.ndarray, np.ndarray]:
    """Places [image, pixel] carried through strokes [image, stroke], the last one first, each felt by its `weight`."""
    width, reach = np.maximum(WIDTH_LEAST, WIDTH_SHARE * radius), REACH_SHARE * radius
    square, oy, ox = width * width, y2 - y1, x2 - x1
    for i in range(x1.shape[1] - 1, -1, -1):
        one = np.s_[:, i : i + 1]
        dy, dx = y - y1[one], x - x1[one]
        w = strength[one] * np.exp(-0.5 * (dy * dy + dx * dx) / square[one])
        w[(np.abs(dy) > reach[one]) | (np.abs(dx) > reach[one])] = 0.0
        y, x = y + oy[one] * w, x + ox[one] * w
    return y, x


def summed_field(pixels: DataFrame, strokes: DataFrame, keys: list[str], tissue: str | None = None) -> DataFrame:
    """keys, y, x, v, u: all strokes' pulls added up, within the tissue if it is told, smoothed, and scaled down where the longest ones are over the bound."""
    p = pixels.select(*keys, "y", "x", *([F.col(tissue).alias("_in")] if tissue else [])).join(strokes.hint("merge"), keys)
    total = lambda a, b: F.aggregate("strokes", F.lit(0.0), lambda t, s: t + (s[b] - s[a]) * weight(F.col("y"), F.col("x"), s, F.col("_in") > 0 if tissue else None))
    raw = p.select(*keys, "y", "x", total("y1", "y2").alias("v"), total("x1", "x2").alias("u"))

    def run(key, pdf):
        (v, y0, x0), (u, _, _) = _grid(pdf, "v"), _grid(pdf, "u")
        v, u = gaussian(v, BLUR), gaussian(u, BLUR)
        most, longest = max(MOST_LEAST, min(v.shape) * MOST_SHARE), float(np.percentile(np.hypot(v, u), MOST_PERCENTILE))
        k = min(1.0, most / max(longest, 1e-6))
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return _tall(keys, key, y, x, v=k * v[y - y0, x - x0], u=k * u[y - y0, x - x0])

    return raw.groupBy(*keys).applyInPandas(run, _schema(pixels, keys, "y int, x int, v double, u double"))


def pushed(raster: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, region_id: the label fetched along the field, nearest pixel, places held to the image."""
    box = raster.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("y", "x") for n, f in (("low", F.min), ("high", F.max))])
    held = lambda c, m: F.rint(F.least(F.greatest(F.col(c) + F.col(m), F.col(f"_low{c}").cast("double")), F.col(f"_high{c}").cast("double"))).cast("int")
    asked = flow.join(box, keys).select(*keys, "y", "x", held("y", "v").alias("_y"), held("x", "u").alias("_x"))
    return asked.join(raster.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), "region_id"), [*keys, "_y", "_x"]).select(*keys, "y", "x", "region_id")


def matte(pixels: DataFrame, keys: list[str], channels: list[str], *, low: float = 12.0, high: float = 40.0, tile: int = 512) -> DataFrame:
    """keys, y, x, alpha (R19): 0 for the background that hangs together with the border, 1 for the tissue, a ramp of colour distance between.

    The background's colour is the median of the border pixels, channel by channel. What is nearer to it than `high` and hangs together with such a border
    pixel is background; of that, distances up to `low` are clear. Holes of the background's colour inside the tissue stay whole. Components go by tiles.
    """
    box = pixels.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("y", "x") for n, f in (("low", F.min), ("high", F.max))])
    p = pixels.join(box, keys)
    p = p.withColumn("_border", (F.col("y") == F.col("_lowy")) | (F.col("y") == F.col("_highy")) | (F.col("x") == F.col("_lowx")) | (F.col("x") == F.col("_highx")))
    base = p.where("_border").groupBy(*keys).agg(*[F.median(c).alias(f"_m_{c}") for c in channels])
    p = p.join(base, keys).withColumn("_d", F.sqrt(sum(((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in channels), F.lit(0.0))))
    p = p.select(*keys, "y", "x", "_d", "_border")
    near = tiled_components(p.where(F.col("_d") < high), keys, tile=tile)
    outside = near.join(p.where("_border").select(*keys, "y", "x"), [*keys, "y", "x"]).select(*keys, "component").distinct().withColumn("_out", F.lit(True))
    marked = p.join(near.join(outside, [*keys, "component"]).select(*keys, "y", "x", "_out"), [*keys, "y", "x"], "left")
    ramp = F.least(F.greatest((F.col("_d") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return marked.select(*keys, "y", "x", F.when(F.col("_out"), ramp).otherwise(1.0).alias("alpha"))
