"""Puts detections into regions: unit projection, raster and voxel look-ups, ontology joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROOT


def um_columns(cells: DataFrame, pixel_um: float, spacing_um: float = 1.0) -> DataFrame:
    """Adds x_um, y_um, z_um where they are absent."""
    new = {"x_um": F.col("x") * pixel_um, "y_um": F.col("y") * pixel_um, "z_um": F.col("slice_id") * F.lit(float(spacing_um))}
    return cells.withColumns({k: v for k, v in new.items() if k not in cells.columns})


def keep_columns(cells: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required columns and those optional ones that exist."""
    return cells.select(*required, *[c for c in optional if c in cells.columns])


def normal_region(region: Column) -> Column:
    """The root counts as outside."""
    return F.when(region == ROOT, 0).otherwise(region)


def hemisphere(code: Column) -> Column:
    """1 left, 2 right, 3 bilateral, else unknown."""
    return F.when(code == 1, "left").when(code == 2, "right").when(code == 3, "bilateral").otherwise("unknown")


def attach_structure(cells: DataFrame, structure: DataFrame) -> DataFrame:
    """Ontology and parent names by region; fallbacks for outside and unknown regions.

    The ontology is a dimension of a few thousand rows; Spark broadcasts it by its size.
    """
    parent = structure.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    s = structure.join(parent, structure["parent_structure_id"] == parent["_pid"], "left").drop("_pid")
    out = cells.join(s.withColumnRenamed("id", "_id"), F.col("region_id") == F.col("_id"), "left").drop("_id")
    rid = F.col("region_id").cast("string")
    return out.withColumns({
        "region_name": F.coalesce("name", F.when(F.col("region_id") == 0, "OUTSIDE_ATLAS").otherwise(F.concat(F.lit("UNKNOWN_REGION_"), rid))),
        "acronym": F.coalesce("acronym", F.when(F.col("region_id") == 0, "OUT").otherwise(F.concat(F.lit("RID_"), rid))),
        "parent_name": F.coalesce("_pname", F.lit("")),
        "hemisphere": hemisphere(F.col("hemisphere_id")),
    }).drop("name", "_pname")


def map_by_slice(cells: DataFrame, slice_regions: DataFrame) -> DataFrame:
    """One region for each slice; cells of unlisted slices are outside."""
    out = cells.join(slice_regions, "slice_id", "left")
    return out.withColumns({"region_id": F.coalesce("region_id", F.lit(0)), "region_name": F.coalesce("region_name", F.lit("OUTSIDE")), "hemisphere": F.coalesce("hemisphere", F.lit("unknown")), "acronym": F.coalesce("acronym", F.lit("OUT"))})


def pixel(c: Column) -> Column:
    """Half-even rounding to a pixel number."""
    return F.rint(c).cast("int")


def look_up_slice(cells: DataFrame, raster: DataFrame, height: int, width: int) -> DataFrame:
    """region_id and mapping_status from tall label images: equi-join on slice and pixel."""
    at = cells.withColumns({"px": pixel(F.col("x")), "py": pixel(F.col("y"))})
    lab = raster.where("region_id <> 0").select("slice_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("region_id").alias("_label"))
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    out = at.join(lab, ["slice_id", "px", "py"], "left")
    rid = F.coalesce(F.when(inside, normal_region(F.col("_label"))), F.lit(0))
    status = F.when(~inside, "outside_slice_bounds").when(rid > 0, "ok").otherwise("outside_registered_slice")
    return out.withColumns({"region_id": rid, "mapping_status": status}).drop("_label")


def look_up_volume(cells: DataFrame, volume: DataFrame, shape: tuple[int, int, int], pixel_um: float, spacing_um: float, voxel_um: float = 25.0) -> DataFrame:
    """region_id and mapping_status from a tall volume (z, y, x, region_id) after micron to voxel conversion."""
    at = um_columns(cells, pixel_um, spacing_um).withColumns({v: pixel(F.col(u) / voxel_um) for v, u in (("vz", "z_um"), ("vy", "y_um"), ("vx", "x_um"))})
    lab = volume.where("region_id <> 0").select(F.col("z").alias("vz"), F.col("y").alias("vy"), F.col("x").alias("vx"), F.col("region_id").alias("_label"))
    inside = F.col("vz").between(0, shape[0] - 1) & F.col("vy").between(0, shape[1] - 1) & F.col("vx").between(0, shape[2] - 1)
    rid = F.coalesce(F.when(inside, normal_region(F.col("_label"))), F.lit(0))
    status = F.when(~inside, "outside_volume").when(rid > 0, "ok").otherwise("outside_atlas")
    return at.join(lab, ["vz", "vy", "vx"], "left").withColumns({"region_id": rid, "mapping_status": status}).drop("_label")


def region_at(raster: DataFrame, structure: DataFrame, slice_id: int, x: int, y: int) -> DataFrame:
    """What stands at one pixel (J06); the filter reaches the scan."""
    hit = raster.where((F.col("slice_id") == slice_id) & (F.col("x") == x) & (F.col("y") == y)).withColumn("region_id", normal_region(F.col("region_id")))
    return attach_structure(hit, structure)
