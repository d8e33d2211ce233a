"""Atlas planes for images: candidates crossed with images, scored, and the best taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 8


def size_ratio_score(image_area: Column, plane_area: Column, shape: Column) -> Column:
    """(smaller area / larger area)^1.5 x the shape score where that is positive."""
    return F.pow(F.least(image_area, plane_area) / F.greatest(image_area, plane_area), F.lit(1.5)) * F.greatest(shape, F.lit(0.0))


def silhouette_score(iou: Column, aspect: Column, area_a: Column | None = None, area_b: Column | None = None) -> Column:
    """0.70 IoU + 0.30 aspect similarity, or with both physical areas 0.40 IoU + 0.45 squared area ratio + 0.15 aspect (M14). The weights."""
    plain = 0.70 * iou + 0.30 * aspect
    if area_a is None or area_b is None:
        return plain
    ratio = F.least(area_a, area_b) / F.greatest(area_a, area_b)
    return F.when((area_a > 0) & (area_b > 0), 0.40 * iou + 0.45 * ratio * ratio + 0.15 * aspect).otherwise(plain)


def aspect_similarity(height_a: Column, width_a: Column, height_b: Column, width_b: Column, pixels_a: Column, pixels_b: Column) -> Column:
    """1 less the relative difference of both boxes' height over width; 0.5 where a mask has ten pixels or fewer."""
    a, b = height_a / F.greatest(width_a, F.lit(1)), height_b / F.greatest(width_b, F.lit(1))
    return F.when((pixels_a > 10) & (pixels_b > 10), 1 - F.least(F.abs(a - b) / F.greatest(a, b, F.lit(0.1)), F.lit(1.0))).otherwise(0.5)


def silhouettes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """IoU and aspect similarity of paired masks (M14). pixels: y, x, a, b (booleans)."""
    box = [F.max(F.when(F.col(m), F.col(c))).alias(f"{m}{c}1") for m in "ab" for c in "yx"] + [F.min(F.when(F.col(m), F.col(c))).alias(f"{m}{c}0") for m in "ab" for c in "yx"]
    s = pixels.groupBy(*keys).agg(F.count_if(F.col("a") & F.col("b")).alias("inter"), F.count_if(F.col("a") | F.col("b")).alias("both"), F.count_if("a").alias("na"), F.count_if("b").alias("nb"), *box)
    size = lambda m, c: F.col(f"{m}{c}1") - F.col(f"{m}{c}0") + 1
    return s.select(*keys, (F.col("inter") / (F.col("both") + 1e-6)).alias("iou"), aspect_similarity(size("a", "y"), size("a", "x"), size("b", "y"), size("b", "x"), F.col("na"), F.col("nb")).alias("aspect"))


def overlap(a: str, b: str) -> Column:
    """IoU of two boolean arrays of one length."""
    both, either = F.zip_with(a, b, lambda x, y: x & y), F.zip_with(a, b, lambda x, y: x | y)
    count = lambda m: F.size(F.filter(m, lambda x: x))
    return count(both) / (count(either) + 1e-6)


def best_plane(images: DataFrame, planes: DataFrame, score: Column, *, step: int = 1, z_range: tuple[int, int] | None = None) -> DataFrame:
    """image, best_z, best_score and the TOP candidates by score: every image against each `step`th plane in range; of equal scores the first plane.

    planes is an atlas, some hundreds of rows whatever the number of images, so it is broadcast; `score` is an expression over both rows. images: image; planes: z.
    """
    lo, hi = z_range or (0, 1 << 30)
    candidates = planes.where(F.col("z").between(lo, hi - 1) & ((F.col("z") - lo) % step == 0))
    scored = images.join(F.broadcast(candidates)).withColumn("_s", score)
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("_s"), "z"))).where(F.col("_r") <= TOP)
    top = F.transform(F.array_sort(F.collect_list(F.struct("_r", "z"))), lambda t: t["z"])
    return ranked.groupBy("image").agg(F.min_by("z", "_r").alias("best_z"), F.max("_s").alias("best_score"), top.alias("coarse_top"))


def refine_by_size(images: DataFrame, planes: DataFrame, shape: Column, *, reach: int = 80) -> DataFrame:
    """image, best_z, best_score: of every second plane around the estimate the TOP by area ratio, then the best area ratio^1.5 x shape score; of equals the one ranked first.

    images: image, z_estimate, image_area; planes: z, plane_area. A plane of fewer than ten pixels ranks with ratio 0. Without a plane in reach the estimate stays, with score 0.
    """
    start = F.greatest(F.lit(0), F.col("z_estimate") - reach)
    near = images.join(F.broadcast(planes)).where((F.col("z") >= start) & (F.col("z") <= F.col("z_estimate") + reach) & ((F.col("z") - start) % 2 == 0))
    ratio = F.when(F.col("plane_area") < 10, 0.0).otherwise(F.least("image_area", "plane_area") / F.greatest("image_area", "plane_area"))
    ranked = near.withColumn("_q", ratio).withColumn("_r", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("_q"), "z"))).where(F.col("_r") <= TOP)
    ranked = ranked.withColumn("_s", F.pow("_q", F.lit(1.5)) * F.greatest(shape, F.lit(0.0)))
    best = ranked.groupBy("image").agg(F.max_by("z", F.struct("_s", -F.col("_r"))).alias("best_z"), F.max("_s").alias("best_score"))
    return images.join(best, "image", "left").select("image", F.coalesce("best_z", "z_estimate").alias("best_z"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def expanded(seeds: DataFrame, score: str, *, top: int = 10, radius: int = 3, last: int = 527) -> DataFrame:
    """The planes within `radius` of the `top` best seeds, each once (W10). A plane is a row, an atlas some hundreds."""
    best = seeds.orderBy(F.desc(score), "z").limit(top)
    return best.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("z") - radius), F.least(F.lit(last), F.col("z") + radius))).alias("z")).distinct()


def first_best(rows: DataFrame, keys: list[str], score: Column, order: str) -> DataFrame:
    """The place of the largest score in each group, the first of equals."""
    return rows.groupBy(*keys).agg(F.max_by(order, F.struct(score, -F.col(order))).alias(order))
