"""Region counts: leaves, ontology roll-up, shares and Poisson intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MORPHOLOGY = ["area_px", "elongation", "mean_intensity"]
Z = 1.96


def poisson_low(n: Column) -> Column:
    """Wilson-Hilferty lower bound, one decimal, half-even; 0 at n = 0."""
    base = 1 - 1 / (9 * n) - Z / (3 * F.sqrt(n))
    return F.when(n <= 0, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), n * base * base * base), 1))


def poisson_high(n: Column) -> Column:
    m = n + 1
    base = 1 - 1 / (9 * m) + Z / (3 * F.sqrt(m))
    return F.bround(m * base * base * base, 1)


def path_ids(path: Column) -> Column:
    """'/997/8/' to [997, 8]; parts that aren't numbers are left out."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(path, F.lit("")), F.lit("/")), "/"), lambda p: p.try_cast("int")), lambda p: p.isNotNull())


def with_share(counts: DataFrame, total: DataFrame) -> DataFrame:
    """confidence = count / max(total, 1), ci_low, ci_high (G02, G03); total is one row, also counting null keys."""
    n = F.col("count").cast("double")
    out = counts.crossJoin(F.broadcast(total.select(F.greatest(F.col("total"), F.lit(1)).alias("total"))))  # one row
    return out.withColumns({"confidence": n / F.col("total"), "ci_low": poisson_low(n), "ci_high": poisson_high(n)}).drop("total")


def leaf_counts(mapped: DataFrame) -> DataFrame:
    """Counts by region and hemisphere with shares, intervals and morphology means."""
    keys = ["region_id", "region_name", "acronym", "hemisphere"]
    total = mapped.agg(F.count("*").alias("total"))
    live = mapped.where(" and ".join(f"{k} is not null" for k in keys))
    aggs = [F.count("*").alias("count"), *[F.avg(F.nanvl(c, F.lit(None))).alias(f"mean_{c}") for c in MORPHOLOGY if c in mapped.columns]]
    aggs += [F.first(c, True).alias(c) for c in ("parent_structure_id", "depth", "graph_order") if c in mapped.columns]
    out = with_share(live.groupBy(*keys).agg(*aggs), total)
    order = [F.col(c).asc_nulls_last() for c in ("graph_order", "region_id", "hemisphere") if c in out.columns]
    return out.orderBy(*order)


def hierarchy_counts(mapped: DataFrame, structure: DataFrame) -> DataFrame:
    """Counts for every ancestor and hemisphere.

    Leaves are counted first, so that what is exploded along the paths is one row a leaf, not one a cell.
    """
    total = mapped.agg(F.count("*").alias("total"))
    leaves = mapped.where("hemisphere is not null and structure_id_path is not null").groupBy("structure_id_path", "hemisphere").agg(F.count("*").alias("c"))
    up = leaves.select(F.explode(path_ids(F.col("structure_id_path"))).alias("region_id"), "hemisphere", "c")
    counts = up.groupBy("region_id", "hemisphere").agg(F.sum("c").alias("count"))
    meta = structure.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"), "acronym", "parent_structure_id", "depth", "graph_order")
    out = with_share(counts.join(meta, "region_id", "left"), total)
    return out.orderBy(F.col("depth").asc_nulls_last(), "region_id", "hemisphere")


def aggregate_by_region(mapped: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaf and hierarchy tables (G06); without an ontology path the hierarchy is empty."""
    if "structure_id_path" not in mapped.columns:
        return leaf_counts(mapped), hierarchy_counts(mapped.withColumn("structure_id_path", F.lit(None).cast("string")), structure)
    return leaf_counts(mapped), hierarchy_counts(mapped, structure)
