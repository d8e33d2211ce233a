"""Detections of a run: tiles put together, detectors chosen, results summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import thin


def merge_tiles(found: DataFrame) -> DataFrame:
    """Detections of tiles in slice coordinates: each tile's offset added (M18). Cells in an overlap come once for each tile; suppression takes them out. found: x, y, tile_x, tile_y."""
    return found.withColumns({"x": F.col("x") + F.col("tile_x"), "y": F.col("y") + F.col("tile_y")}).drop("tile_x", "tile_y")


def numbered(cells: DataFrame, order: list) -> DataFrame:
    """cell_id from 1 in each slice."""
    return cells.withColumn("cell_id", F.row_number().over(Window.partitionBy("slice_id").orderBy(*order)).cast("long"))


def dispatch(primary: DataFrame | None, secondary: DataFrame | None, fallback: DataFrame | None, *, merge: bool = False, allow_fallback: bool | None = None, requested: bool = True, radius: float = 4.0) -> DataFrame:
    """The detections that count in each slice (M20), suppressed within the radius and numbered from 1.

    A slice takes the primary detector's cells if it has any (with the secondary one's, if these are to be merged), else the secondary one's,
    else the fallback's, as they are, where that is allowed (by default only if no model was asked for). Cells: slice_id, x, y, score, detector.
    Of equal scores the cell that comes first by source, x, y and detector stays.
    """
    allowed = not requested if allow_fallback is None else allow_fallback
    cols = ["slice_id", "x", "y", "score", "detector"]
    parts, has = [], None
    for i, df in enumerate((primary, secondary)):
        if df is None:
            continue
        rows = df.select(*cols, F.lit(i).alias("_source"))
        here = rows.select("slice_id").distinct()
        parts.append(rows if has is None or merge else rows.join(has, "slice_id", "left_anti"))
        has = here if has is None else has.unionByName(here).distinct()
    kept = None
    order = ["_source", F.desc_nulls_last("score"), "x", "y", "detector"]
    if parts:
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows = numbered(rows, order).withColumn("_slice_cell", F.col("cell_id")).withColumn("cell_id", F.xxhash64("slice_id", "cell_id"))
        best = Window.partitionBy("slice_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "_slice_cell")
        rows = rows.withColumn("_rank", F.row_number().over(best))
        rows = thin(rows, r_xy=radius, group=["slice_id"], score=-F.col("_rank")).where("kept").drop("kept")
        kept = numbered(rows, ["_slice_cell"]).select("cell_id", *cols)
    if fallback is not None and allowed:
        rest = fallback.select(*cols, F.lit(2).alias("_source"))
        rest = rest if has is None else rest.join(has, "slice_id", "left_anti")
        rest = numbered(rest, order).select("cell_id", *cols)
        kept = rest if kept is None else kept.unionByName(rest)
    if kept is None:
        raise ValueError("no detector is allowed")
    return kept


def summary(cells: DataFrame, deduped: DataFrame, *, sampling_mode: str = "single", interval: int = 1, primary: str = "", secondary: str = "", allow_fallback: bool | None = None, atlas: Column | None = None) -> DataFrame:
    """One row on a run's detections (R09): modes, models, whether instance segmentation was asked for, counts before and after suppression, in all and by detector as JSON with sorted names."""
    asked = primary.lower().startswith("cellpose") or secondary.lower().startswith("cellpose")

    def counts(df: DataFrame, total: str, by: str) -> DataFrame:
        each = df.groupBy(F.coalesce("detector", F.lit("unknown")).alias("d")).agg(F.count("*").alias("n"))
        entries = F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("d"), F.lit('": '), F.col("n").cast("string"))))
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total), F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias(by))

    # one row each
    out = counts(cells, "cells_detected", "detector_counts").crossJoin(counts(deduped, "cells_dedup", "dedup_detector_counts"))
    told = {"sampling_mode": F.lit(sampling_mode), "slice_interval_n": F.lit(interval), "primary_model": F.lit(primary), "secondary_model": F.lit(secondary), "requested_instance_segmentation": F.lit(asked), "allow_fallback": F.lit(not asked if allow_fallback is None else allow_fallback)}
    return out.withColumns(told if atlas is None else told | {"atlas_sha256": atlas})
