"""Comparisons across channels, samples and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ap_density(mapped: DataFrame, qc: DataFrame) -> DataFrame:
    """Cells by slice along the axis: counts with the slice's first registered position."""
    counts = mapped.groupBy("slice_id").agg(F.count("*").alias("count"))
    one = qc.withColumn("_r", F.row_number().over(Window.partitionBy("slice_id").orderBy("best_z"))).where("_r = 1").select("slice_id", "best_z")
    return counts.join(one, "slice_id", "left").where("best_z is not null").orderBy("best_z", "slice_id")


def channel_totals(leaf: DataFrame) -> DataFrame:
    return leaf.groupBy("channel").agg(F.sum("count").alias("total"))


def coexpression(red: DataFrame, green: DataFrame, key: str) -> DataFrame:
    """Both channels' counts on a key, 0 where one is missing."""
    r, g = red.select(key, F.col("count").alias("red")), green.select(key, F.col("count").alias("green"))
    out = r.join(g, key, "full_outer").withColumns({"red": F.coalesce("red", F.lit(0)), "green": F.coalesce("green", F.lit(0))})
    return out.withColumns({"both": F.least("red", "green"), "ratio": F.bround(F.col("red") / F.greatest(F.col("red") + F.col("green"), F.lit(1)), 6)})


def compare_samples(counts: DataFrame, labels: list[str]) -> DataFrame:
    """One row a region and hemisphere, a count and a share for each sample, first-seen names.

    counts: label, region_id, hemisphere, region_name, acronym, depth, count, confidence.
    """
    order = F.create_map(*[x for i, lb in enumerate(labels) for x in (F.lit(lb), F.lit(i))])[F.col("label")]
    out = counts.groupBy("region_id", "hemisphere").agg(
        F.min_by(F.struct("region_name", "acronym", "depth"), order).alias("m"),
        *[F.coalesce(F.max(F.when(F.col("label") == lb, F.col("count"))), F.lit(0)).alias(f"count_{lb}") for lb in labels],
        *[F.bround(F.coalesce(F.max(F.when(F.col("label") == lb, F.col("confidence"))), F.lit(0.0)), 6).alias(f"confidence_{lb}") for lb in labels],
    )
    return out.select("region_id", "hemisphere", "m.*", *[c for c in out.columns if c.startswith(("count_", "confidence_"))]).orderBy(F.coalesce("depth", F.lit(99)), "region_id", "hemisphere")
