"""Scores and choices among registration candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def objective(quality: Column, coverage: Column, left: Column, right: Column) -> Column:
    """Quality with bonuses for coverage and penalties for gaps (M12). The weights."""
    low, gap = F.least(left, right), F.abs(left - right)
    over = lambda c: F.greatest(F.lit(0.0), c)
    return quality + 0.34 * coverage + 0.30 * low - 1.08 * over(gap - 0.14) - 2.15 * over(0.93 - coverage) - 1.30 * over(0.78 - low)


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of largest score; an optimised score counts unless it is worse than the first by more than 0.003."""
    score = F.when(F.col("optimised") >= F.col("initial") - 0.003, F.col("optimised")).otherwise(F.col("initial"))
    c = candidates.withColumn("s", score)
    return c.groupBy(*keys).agg(F.max_by("ord", F.struct("s", -F.col("ord"))).alias("candidate"), F.max("s").alias("objective"))


def nonlinear(baseline: Column, flow: Column, liquify: Column, ants: Column) -> Column:
    """Method by preference margins."""
    best = F.greatest(baseline, flow, liquify, ants)
    return (F.when((liquify >= best - 0.003) & (liquify >= baseline + 0.006), "liquify").when((ants >= best - 0.0025) & (ants >= baseline + 0.004), "ants").when(baseline == best, "baseline").when(flow == best, "flow").when(liquify == best, "liquify").otherwise("ants"))


def accept_external(mask_before: Column, mask_after: Column, inner_before: Column, inner_after: Column) -> Column:
    """An external transform counts unless mask overlap falls by more than 0.006 or inner label area by more than 0.012."""
    return (mask_after >= mask_before - 0.006) & (inner_after >= inner_before * (1 - 0.012))


def placement_scale(tissue_area: Column, atlas_area: Column) -> Column:
    """sqrt of the area ratio in 0.5 to 1.5."""
    return F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.sqrt(tissue_area / atlas_area)))


def match_by_angle(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """For n even angles, each side's point of least circular difference, ties by order (M37). points: side (a, b), angle, ord."""
    t = points.select(*keys, "side", "angle", "ord", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    target = 2 * math.pi * F.col("k") / n - math.pi
    d = F.col("angle") - target
    d = F.round(F.abs(d - 2 * math.pi * F.round(d / (2 * math.pi))), 9)
    pick = lambda s: F.min_by(F.when(F.col("side") == s, F.col("ord")), F.when(F.col("side") == s, F.struct(d, "ord"))).alias(s)
    return t.groupBy(*keys, "k").agg(pick("a"), pick("b"))
