"""Continuity of an ordered slice series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AP_MAX


def smooth(qc: DataFrame, *, series: str = "series", max_dev: float = 8.0) -> DataFrame:
    """original_z, smoothed_z, deviation, is_outlier for each slice of each series.

    Over slices with a registration, a centred median of 5 (of n if n < 5; 2 before and 1 after for n = 4). A failed slice takes the smoothed
    value of the nearest good one, the smaller id on a tie. With fewer than two good slices the
    originals are repeated; with two, deviations are 0.
    """
    w = Window.partitionBy(series).orderBy("slice_id")
    z = F.col("best_z").cast("double")
    # one exchange by series; slices with a registration are a partition of their own for the median, whose frame is five rows at most
    own = Window.partitionBy(series, "registration_ok").orderBy("slice_id")
    out = qc.repartition(series).withColumn("_n", F.count("*").over(Window.partitionBy(series, "registration_ok")))
    out = out.withColumns({f"_z{k}": F.lag(z, -k).over(own) for k in (-2, -1, 1, 2)})
    near = lambda k, least: F.when(F.col("_n") >= least, F.col(f"_z{k}"))
    out = out.withColumn("_v", F.array_sort(F.array_compact(F.array(near(-2, 4), near(-1, 3), z, near(1, 3), near(2, 5)))))
    middle = lambda i: F.get("_v", F.floor((F.size("_v") - i) / 2).cast("int"))
    out = out.withColumn("_raw", F.when(F.col("registration_ok") & (F.col("_n") >= 2), (middle(1) + middle(0)) / 2))
    clip = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(AP_MAX))).cast("int")
    # what comes after is looked up in falling order, as a frame that ends with the partition is added up anew for each row
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(series).orderBy(F.desc("slice_id")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_raw").isNotNull(), F.struct(F.col("slice_id").alias("s"), clip(F.col("_raw")).alias("v")))
    out = out.withColumns({"_b": F.last(known, True).over(before), "_a": F.last(known, True).over(after)})
    near_after = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a.s") - F.col("slice_id") < F.col("slice_id") - F.col("_b.s")))
    fill = F.when(near_after, F.col("_a.v")).otherwise(F.col("_b.v"))
    smoothed = F.coalesce(F.when(F.col("_raw").isNotNull(), clip(F.col("_raw"))), fill, F.col("best_z"))
    dev = F.when(F.col("_raw").isNotNull(), F.abs(z - F.col("_raw"))).otherwise(F.when(F.col("_b").isNull() & F.col("_a").isNull(), 0.0).otherwise(F.abs(z - fill)))
    return out.select(series, "slice_id", F.col("best_z").alias("original_z"), smoothed.alias("smoothed_z"), F.bround(dev, 2).alias("deviation"), (F.col("_raw").isNotNull() & (dev > max_dev)).alias("is_outlier"), F.col("_raw").isNotNull().alias("fitted"))


def report(smoothed: DataFrame, *, series: str = "series") -> DataFrame:
    """Outlier count, largest and mean deviation of fitted slices, and whether smoothed_z never falls."""
    w = Window.partitionBy(series).orderBy("slice_id")
    step = smoothed.withColumn("_up", F.coalesce(F.col("smoothed_z") >= F.lag("smoothed_z").over(w), F.lit(True)))
    fitted = F.when(F.col("fitted"), F.col("deviation"))
    return step.groupBy(series).agg(F.count("*").alias("n_slices"), F.count_if("is_outlier").alias("outlier_count"), F.coalesce(F.max(fitted), F.lit(0.0)).alias("max_deviation"), F.coalesce(F.bround(F.avg(fitted), 2), F.lit(0.0)).alias("mean_deviation"), F.bool_and("_up").alias("monotone"))


def report_document(smoothed: DataFrame, *, series: str = "series") -> DataFrame:
    """The same as parallel arrays, one document a series (M7)."""
    rows = smoothed.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("slice_id", "original_z", "smoothed_z", "deviation", "is_outlier"))).alias("r"))
    return rows.select(series, *[F.col(f"r.{c}").alias(f"{c}s") for c in ("slice_id", "original_z", "smoothed_z", "deviation", "is_outlier")])
