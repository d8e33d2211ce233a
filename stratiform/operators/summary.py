"""Summaries of a mapped run: groups, top regions, detectors, sources, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_set

# Analysis groups, first match wins, and display names that say nothing.
GROUPS = [("Striatum", 477), ("Pallidum", 803), ("Isocortex", 315), ("Olfactory Areas", 698), ("Hippocampal Formation", 1089), ("Thalamus", 549), ("Hypothalamus", 1097), ("Midbrain", 313), ("Pons", 771), ("Medulla", 354), ("Cerebellum", 512), ("Cortical Subplate", 703), ("Fiber Tracts", 1009), ("Ventricular System", 73)]
GENERIC = ["root", "Basic cell groups and regions", "Cerebrum", "Cerebral cortex", "Cortical plate", "Cerebral nuclei", "Brain stem", "fiber tracts", "ventricular systems"]
TOP, OUTSIDE_WARNING = 14, 0.05


def slice_qc(mapped: DataFrame) -> DataFrame:
    """Cells of each slice and a status."""
    return mapped.where("slice_id is not null").groupBy("slice_id").agg(F.count("*").alias("cell_count")).withColumn("status", F.when(F.col("cell_count") > 0, "ok").otherwise("empty"))


def detector_counts(cells: DataFrame) -> DataFrame:
    """Cells by detector, null as unknown."""
    return cells.groupBy(F.coalesce("detector", F.lit("unknown")).alias("detector")).agg(F.count("*").alias("count"))


def display_region(name: Column, parent: Column) -> Column:
    """The parent's name unless it says nothing or is the region's own."""
    p, n = F.trim(F.coalesce(parent, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    return F.when((p != "") & ~p.isin(GENERIC) & (p != n), p).otherwise(F.coalesce(F.nullif(n, F.lit("")), F.lit("Unknown")))


def meaningful(acronym: Column, name: Column) -> Column:
    """Neither empty, all digits nor generic."""
    ok = lambda c: (F.trim(c) != "") & ~c.rlike(r"^[0-9]+$")
    return F.coalesce(ok(acronym) & ok(name) & ~F.lower(name).isin([g.lower() for g in GENERIC]), F.lit(False))


def group_label(path: Column, region: Column, groups: list[tuple[str, int]] = GROUPS) -> Column:
    """First of the ordered groups on the path, else Other Mapped."""
    ids = id_set(path, region)
    out = F.lit("Other Mapped")
    for label, gid in reversed(groups):
        out = F.when(F.array_contains(ids, gid), label).otherwise(out)
    return out


def analysis_groups(mapped: DataFrame, groups: list[tuple[str, int]] = GROUPS) -> DataFrame:
    """Cells of each group; cells outside are a group of their own (G13). Counted by path first."""
    by = mapped.groupBy("mapping_status", "structure_id_path", "region_id").agg(F.count("*").alias("c"))
    label = F.when(F.col("mapping_status") == "ok", group_label(F.col("structure_id_path"), F.col("region_id"), groups)).otherwise("Outside Atlas")
    return by.groupBy(label.alias("label")).agg(F.sum("c").alias("count"))


def top_regions(mapped: DataFrame, k: int = TOP) -> DataFrame:
    """The k display regions with most cells (G14, T04); ties by name."""
    by = mapped.where("mapping_status = 'ok'").groupBy(display_region(F.col("region_name"), F.col("parent_name")).alias("region")).agg(F.count("*").alias("count"))
    return by.orderBy(F.desc("count"), "region").limit(k)


def totals(mapped: DataFrame) -> DataFrame:
    """total, mapped, outside, share and warning."""
    out = mapped.agg(F.count("*").alias("total"), F.count_if(F.col("mapping_status") == "ok").alias("mapped"), F.countDistinct("slice_id").alias("slices"))
    out = out.withColumn("outside", F.col("total") - F.col("mapped"))
    ratio = F.col("outside") / F.greatest(F.col("total"), F.lit(1))
    return out.withColumns({"outside_pct": F.bround(ratio * 100, 2), "warning": F.when(ratio >= OUTSIDE_WARNING, F.format_string("%.1f%% of cells are outside the atlas", ratio * 100)).otherwise("")})


def cell_summary(mapped: DataFrame) -> DataFrame:
    """Totals with the top region and detectors in one row (G16, G18); the parts are a row each."""
    top = top_regions(mapped, 1).select(F.col("region").alias("top_region"), F.col("count").alias("top_count"))
    det = mapped.agg(F.array_join(F.array_sort(F.collect_set(F.trim("detector"))), ", ").alias("detectors"))
    return totals(mapped).join(top, F.lit(True), "left").crossJoin(det)


def hierarchy_summary(hierarchy: DataFrame, depths: tuple[int, int] = (4, 7)) -> DataFrame:
    """Regions of the given depths with cells and no layer in the name, against the root's count."""
    root = hierarchy.agg(F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("count"))), F.sum("count")).alias("root"))
    live = hierarchy.where((F.col("count") > 0) & F.col("depth").between(*depths) & ~F.lower("region_name").contains("layer"))
    return live.groupBy("region_name").agg(F.max("count").alias("count")).crossJoin(F.broadcast(root)).withColumn("pct", F.bround(100 * F.col("count") / F.greatest("root", F.lit(1)), 2))  # root: one row


def depth_chart(hierarchy: DataFrame, depth: int = 2) -> DataFrame:
    """Regions of one depth with their share of that depth."""
    live = hierarchy.where((F.col("depth") == depth) & (F.col("count") > 0)).groupBy("region_id", "region_name").agg(F.sum("count").alias("count"))
    total = live.agg(F.sum("count").alias("t"))
    return live.crossJoin(F.broadcast(total)).select("region_id", "region_name", "count", F.bround(100 * F.col("count") / F.col("t"), 4).alias("pct"))  # one row


def results_table(hierarchy: DataFrame, keyword: str = "") -> DataFrame:
    """Rows whose name or acronym holds the keyword, with a percent text of the root count."""
    base = hierarchy.agg(F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("count"))), F.max("count")).alias("base"))
    kw = keyword.lower()
    rows = hierarchy.where(F.lower("region_name").contains(kw) | F.lower("acronym").contains(kw))
    return rows.crossJoin(F.broadcast(base)).select("region_id", "hemisphere", "region_name", "count", F.format_string("%.1f%%", 100 * F.col("count") / F.greatest("base", F.lit(1))).alias("pct"))  # one row


def file_samples(cells: DataFrame) -> DataFrame:
    """Cells and sorted detectors of each slice."""
    return cells.groupBy("slice_id").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("detector")), ", ").alias("detectors"))


def even_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at positions floor(i (n-1) / (k-1)), fewer where they meet (W08). For tables of one row a slice: the numbering is global."""
    numbered = df.withColumns({"_i": F.row_number().over(Window.orderBy(order)) - 1, "_n": F.count("*").over(Window.partitionBy())})
    span = F.greatest(F.lit(k - 1), F.lit(1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / span))
    return numbered.where(F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def first_per_key(df: DataFrame, key: Column, order: list[Column], k: int) -> DataFrame:
    """The best row of each key, then the k best of those."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return best.orderBy(*order).limit(k)


def source_summary(cells: DataFrame) -> DataFrame:
    """Most frequent folder (ties: the smaller), slices, z range."""
    folders = cells.groupBy("folder").agg(F.count("*").alias("n"))
    top = folders.agg(F.max_by("folder", F.struct("n", F.transform(F.split("folder", ""), lambda c: -F.ascii(c)))).alias("folder"))
    return top.crossJoin(cells.agg(F.countDistinct("slice_id").alias("slices"), F.min("z").alias("min_z"), F.max("z").alias("max_z")))
