"""Exact k nearest neighbours within groups, over grids that coarsen until every point is served."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Tables


def knn_join(left: DataFrame, right: DataFrame, group: str, k: int) -> DataFrame:
    """a, b, k: for each left point (id, x, y) its k nearest right points of the group, ties by id.

    Points meet over square cells: a left place looks at the nine cells around it and is served once k right
    points lie within one cell side, as no nearer one can be farther off than those cells. The rest try again
    with sides twice as long. A group's points spread over its cells, so no task holds a group. Of right points
    at one place only the k smallest ids take part, and left points at one place are served together; a
    dense right cluster that many left places see from afar, with nothing nearer, still meets all of them.
    Points are exploded over cells and saved in small files, so joins of points are told not to broadcast a side.

    Points without a finite place or a group, and groups on one side only, give no rows; a group of
    fewer than k right points gives all of them.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col(group).isNotNull()
    cols = [group, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    place = [group, "x", "y"]
    tables = Tables(left.sparkSession)
    right = right.select(cols).where(finite)
    right = tables.save(right.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).where(F.col("_n") <= k).drop("_n"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    per = k / F.col("n")
    side = F.greatest(F.sqrt(wide * high * per), F.greatest(wide, high) * per)
    extent = right.groupBy(group).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    extent = extent.select(group, "x0", "y0", F.when(side > 0, side).otherwise(1.0).alias("side"), F.least("n", F.lit(k)).alias("need"))
    left = left.select(cols).where(finite)
    todo = tables.save(left.select(*place).distinct().join(extent, group))
    targets = tables.save(right.join(extent.drop("need"), group))
    off = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    served, scale = None, 1.0
    while not todo.isEmpty():
        at = lambda c, s=scale: F.floor((F.col(c) - F.col(f"{c}0")) / (F.col("side") * s))
        cells = targets.select(group, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), at("x").alias("cx"), at("y").alias("cy"))
        ask = todo.select(*place, "need", (F.col("side") * scale * (1 - 1e-9)).alias("reach"), F.explode(off).alias("dx"), at("x").alias("cx"), at("y").alias("cy"))
        ask = ask.select("*", F.explode(off).alias("dy")).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
        d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
        near = ask.join(cells.hint("merge"), [group, "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= F.col("reach") * F.col("reach"))
        best = near.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy("d2", "b"))).where(F.col("k") <= k)
        found = best.withColumn("got", F.count("*").over(Window.partitionBy(*place))).where("got = need").select(*place, "b", "k")
        found = tables.save(found)
        served = found if served is None else served.unionByName(found)
        before, todo = todo, tables.save(todo.join(found.where("k = 1").select(*place).hint("merge"), place, "left_anti"))
        tables.drop(before)
        scale *= 2
    if served is None:
        return left.sparkSession.createDataFrame([], "a long, b long, k long")
    return left.join(served.hint("merge"), place).select(F.col("id").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("k").cast("long").alias("k"))
