"""Score-ordered suppression of near detections."""

from __future__ import annotations

from itertools import product
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Tables


def near_pairs(cells: DataFrame, *, r_xy: float, group: list[str], r_z: float | None = None, neighbor_slices: int = 0) -> DataFrame:
    """a, b, dist2 for pairs a < b in one group within an ellipsoid, radius 1 included.

    Cells meet over a grid as wide as the radius: an equi-join on the cell of one side and the nine
    around it of the other, then the distance. Without r_z, z counts for nothing; with it the grid has
    layers, of one slice where neighbor_slices is given, else of r_z, and each layer meets itself and those
    above it that are within reach. Neither side is broadcast, however small its file is.
    """
    z = F.col("z") if r_z is not None else F.lit(0.0)
    keys = [F.col(g) for g in group]
    base = cells.select(*keys, F.col("cell_id"), F.col("x"), F.col("y"), z.alias("z"), *([F.col("slice_id").alias("_s")] if neighbor_slices else []), F.floor(F.col("x") / r_xy).alias("gx"), F.floor(F.col("y") / r_xy).alias("gy"))
    layered = r_z is not None
    if layered:
        base = base.withColumn("gz", F.floor("_s") if neighbor_slices else F.floor(F.col("z") / r_z))
    off = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = base.select("*", F.explode(off).alias("dx")).select("*", F.explode(off).alias("dy")).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).drop("dx", "dy")
    if layered:
        left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(neighbor_slices or 1))).alias("up")).withColumn("gz", F.col("gz") + F.col("up"))
    cell = ["gx", "gy", *(["gz"] if layered else [])]
    right = base.select(*[F.col(g) for g in group], *cell, *[F.col(c).alias(f"{c}2") for c in ("cell_id", "x", "y", "z", *(["_s"] if neighbor_slices else []))])
    d2 = ((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2) / (r_xy * r_xy)
    if r_z is not None:
        d2 = d2 + ((F.col("z") - F.col("z2")) / r_z) ** 2
    once = F.col("cell_id") < F.col("cell_id2")
    if layered:
        once = once | ((F.col("up") > 0) & (F.col("cell_id") != F.col("cell_id2")))
    out = left.join(right.hint("merge"), [*group, *cell]).where(once & (d2 <= 1.0))
    if neighbor_slices:
        out = out.where(F.abs(F.col("_s") - F.col("_s2")) <= neighbor_slices)
    return out.select(F.least("cell_id", "cell_id2").alias("a"), F.greatest("cell_id", "cell_id2").alias("b"), d2.alias("dist2"))


def suppress(cells: DataFrame, pairs: DataFrame, score: Column | None = None) -> DataFrame:
    """cells with `kept`: each, from the highest score on (ties: smaller id), is kept unless a kept one is near.

    Equals the sequential rule, done in rounds: an undecided cell better than all its undecided neighbours
    is kept, its neighbours go. A null score ranks as 0.
    """
    rank = cells.select("cell_id", F.coalesce(score if score is not None else F.col("score"), F.lit(0.0)).alias("s"))
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.join(rank.select(F.col("cell_id").alias("a"), F.col("s").alias("sa")), "a").join(rank.select(F.col("cell_id").alias("b"), F.col("s").alias("sb")), "b")
    tables = Tables(cells.sparkSession)
    edges = tables.save(edges)
    gone = None
    while True:
        # (score, -id) of the best undecided neighbour against one's own
        best = edges.groupBy("a", "sa").agg(F.max(F.struct(F.col("sb").alias("s"), (-F.col("b")).alias("i"))).alias("m"))
        winners = best.where(F.struct(F.col("sa").alias("s"), (-F.col("a")).alias("i")) > F.col("m")).select("a")
        losers = tables.save(edges.join(winners, "a", "left_semi").select(F.col("b").alias("cell_id")).distinct())
        gone = losers if gone is None else gone.unionByName(losers)
        won = winners.select(F.col("a").alias("cell_id")).unionByName(losers)
        left = edges.join(won.select(F.col("cell_id").alias("a")), "a", "left_anti").join(won.select(F.col("cell_id").alias("b")), "b", "left_anti")
        before, edges = edges, tables.save(left.select("a", "b", "sa", "sb"))
        tables.drop(before)
        if edges.isEmpty():
            break
    return cells.join(gone.distinct().withColumn("_gone", F.lit(True)), "cell_id", "left").withColumn("kept", F.col("_gone").isNull()).drop("_gone")


BLOCK, HALO = 48, 8  # of a block and of what it sees around, in radii
BLOCK_POINTS = 50_000  # what a task takes at once; denser blocks are thinned by cells first
CALL_POINTS = 20_000  # small blocks go to Python together, about so many points in a call


def settled(at: np.ndarray, sizes: np.ndarray, flat: int, rank: np.ndarray, sure: np.ndarray, open_edge: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """What is certain of the points of a block and its halo, taken from the best on: 1 kept, -1 out, 0 not certain.

    A point is out if a better one that is kept is near. It is kept if none is near that is better and not certain itself, and nothing beyond the halo (open_edge) can be near. Points that are
    `sure` are kept already. Only kept and uncertain points are compared with, so a dense spot costs its points. Points of different parts (blocks) don't see one another.
    """
    out = np.zeros(len(at), np.int8)
    cell = np.column_stack([np.zeros(len(at), np.int64) if part is None else part, np.floor(at / (sizes * (1 + 1e-9))).astype(np.int64)])
    around = [(0, *step) for step in product((-1, 0, 1), repeat=at.shape[1])]
    held: dict[tuple, list[tuple]] = {}
    places, cells_of = at.tolist(), cell.tolist()
    r2, rz = float(sizes[0] ** 2), float(sizes[-1])
    for i in np.lexsort((-rank, ~sure)).tolist():
        here, c = places[i], cells_of[i]
        state = 1 if sure[i] or not open_edge[i] else 0
        if not sure[i]:
            for step in around:
                for there, known in held.get(tuple(map(add, c, step)), ()):
                    d = ((here[0] - there[0]) ** 2 + (here[1] - there[1]) ** 2) / r2
                    if not flat:
                        d += ((here[2] - there[2]) / rz) ** 2
                    if d <= 1.0:
                        state = -1 if known else min(state, 0)
                        if state < 0:
                            break
                if state < 0:
                    break
        out[i] = state
        if state >= 0:
            held.setdefault(tuple(c), []).append((here, state))
    return out


def thin(cells: DataFrame, *, r_xy: float, group: list[str], r_z: float | None = None, score: Column | None = None) -> DataFrame:
    """cells with `kept`, the same as suppress() over near_pairs(), without making the pairs: a dense spot costs its points, not their square.

    Each round decides whatever is certain within blocks that see HALO radii around them, in one pass from the best point on; what hangs on points further away waits for the next round,
    whose blocks lie half a block aside. Blocks go to Python many at a time, so that a great many small groups don't cost a call each. If a block has more than BLOCK_POINTS undecided points, a round by cells comes first (by_cells). Points without a finite place or a group are kept.
    """
    tables = Tables(cells.sparkSession)
    dims = ["x", "y"] if r_z is None else ["x", "y", "z"]
    sizes = np.array([r_xy, r_xy, r_z][: len(dims)], float)
    finite = [F.abs(F.col(c)) < float("inf") for c in dims] + [F.col(g).isNotNull() for g in group]
    ok = F.coalesce(finite[0], F.lit(False))
    for f in finite[1:]:
        ok = ok & F.coalesce(f, F.lit(False))
    base = cells.where(ok).select(*group, "cell_id", F.coalesce(score if score is not None else F.col("score"), F.lit(0.0)).cast("double").alias("s"), *[F.col(c).cast("double").alias(c) for c in dims], F.lit(False).alias("sure"))
    schema = "cell_id " + cells.schema["cell_id"].dataType.simpleString() + ", state int"

    def judge(shift: float, at: list[str]):
        def run(pdf):
            q = pdf[dims].to_numpy(float)
            scaled, sure = q / sizes - shift, pdf["sure"].to_numpy(bool)
            block = pdf[at[len(group) :]].to_numpy(float) * BLOCK
            part = pdf.groupby(at, sort=False).ngroup().to_numpy()
            inside = ((scaled >= block) & (scaled < block + BLOCK)).all(1)
            edge = ((scaled < block - HALO + 1.001) | (scaled > block + BLOCK + HALO - 1.001)).any(1)
            order = np.lexsort((pdf["cell_id"].to_numpy(), -pdf["s"].to_numpy()))
            rank = np.empty(len(order))
            rank[order] = -np.arange(len(order))
            state = settled(q, sizes, r_z is None, rank, sure, edge, part)
            mine = inside & ~sure & (state != 0)
            return pd.DataFrame({"cell_id": pdf["cell_id"][mine], "state": state[mine].astype(np.int32)})

        return run

    undecided, kept, gone = tables.save(base), None, None
    number = 0
    while not undecided.isEmpty():
        shift = (number % 2) * BLOCK / 2
        place = [F.floor((F.col(c) / float(n) - shift) / BLOCK).alias(f"_b{c}") for c, n in zip(dims, sizes, strict=True)]
        at = [*group, *[f"_b{c}" for c in dims]]
        most, every = undecided.groupBy(*group, *place).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if most > BLOCK_POINTS:
            won, out = by_cells(undecided.drop("sure"), tables, dims=dims, group=group, r_xy=r_xy, r_z=r_z)
            kept = won.select(*group, "cell_id", "s", *dims, F.lit(True).alias("sure"))
        else:
            seen = undecided if kept is None else undecided.unionByName(kept)
            for c, n in zip(dims, sizes, strict=True):
                q = F.col(c) / float(n) - shift
                seen = seen.withColumn(f"_b{c}", F.explode(F.sequence(F.floor((q - HALO) / BLOCK), F.floor((q + HALO) / BLOCK))))

            call = F.pmod(F.xxhash64(*at), F.lit(every // CALL_POINTS + 1)).alias("_call")
            out = tables.save(seen.groupBy(call).applyInPandas(judge(shift, at), schema)).select("cell_id", (F.col("state") == 1).alias("_kept"))
            kept = undecided.join(out.where("_kept"), "cell_id", "left_semi").withColumn("sure", F.lit(True))
        gone = out.where("not _kept") if gone is None else gone.unionByName(out.where("not _kept"))
        undecided = tables.save(undecided.join(out, "cell_id", "left_anti"))
        number += 1
    if gone is None:
        return cells.withColumn("kept", F.lit(True))
    return cells.join(gone.select("cell_id", F.lit(True).alias("_gone")), "cell_id", "left").withColumn("kept", F.col("_gone").isNull()).drop("_gone")


def by_cells(undecided: DataFrame, tables: Tables, *, dims: list[str], group: list[str], r_xy: float, r_z: float | None) -> tuple[DataFrame, DataFrame]:
    """A round of thin() for dense spots: the points kept now, and cell_id, _kept of all points that this decides.

    Points fall into cells whose points are all near one another, so only a cell's best undecided point can be kept next. It is, if no better undecided point
    is near: that is sure where no neighbouring cell's best is better, not so where a better one of them is near, and looked up among the neighbours' points else. Then all
    points near a kept one are out.
    """
    side = {c: (r_z if c == "z" else r_xy) / len(dims) ** 0.5 * (1 - 1e-9) for c in dims}
    keys = [*group, *(f"_c{c}" for c in dims)]
    undecided = undecided.withColumns({f"_c{c}": F.floor(F.col(c) / side[c]) for c in dims})
    rank = lambda p="": F.struct(F.col(f"{p}s").alias("s"), (-F.col(f"{p}cell_id")).alias("i"))
    near = ((F.col("x") - F.col("a_x")) ** 2 + (F.col("y") - F.col("a_y")) ** 2) / (r_xy * r_xy)
    if r_z is not None:
        near = near + ((F.col("z") - F.col("a_z")) / r_z) ** 2
    near = near <= 1.0
    mine = ["cell_id", "s", *dims]

    def around(points: DataFrame) -> DataFrame:
        """Points as a_cell_id and so on, once for each cell within two of their own."""
        out = points.select(*keys, *[F.col(c).alias(f"a_{c}") for c in mine])
        for c in dims:
            out = out.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]))).withColumn(f"_c{c}", F.col(f"_c{c}") + F.col("_d")).drop("_d")
        return out

    best = undecided.groupBy(*keys).agg(F.max(F.struct(F.col("s").alias("s"), (-F.col("cell_id")).alias("i"), *dims)).alias("t"))
    tops = tables.save(best.select(*keys, (-F.col("t.i")).alias("cell_id"), F.col("t.s").alias("s"), *[F.col(f"t.{c}").alias(c) for c in dims]))
    better = rank() > rank("a_")
    met = around(tops).join(tops, keys).where(better).groupBy(F.col("a_cell_id").alias("cell_id")).agg(F.max(near.cast("int")).alias("beaten"))
    judged = tables.save(tops.join(met, "cell_id", "left"))
    doubt = judged.where("beaten = 0")
    lost = around(doubt).join(undecided, keys).where(better & near).select(F.col("a_cell_id").alias("cell_id")).distinct()
    won = tables.save(judged.where("beaten is null").select(*keys, *mine).unionByName(doubt.join(lost, "cell_id", "left_anti").select(*keys, *mine)))
    out = tables.save(around(won).join(undecided, keys).where(near).select("cell_id", (F.col("cell_id") == F.col("a_cell_id")).alias("_kept")).groupBy("cell_id").agg(F.max("_kept").alias("_kept")))
    return won, out


def in_order(cells: DataFrame) -> DataFrame:
    """Cells by slice and id."""
    return cells.orderBy("slice_id", "cell_id")


def stats(suppressed: DataFrame) -> DataFrame:
    """before, after, merged, ratio."""
    out = suppressed.agg(F.count("*").alias("before"), F.count_if("kept").alias("after"))
    return out.withColumns({"merged": F.col("before") - F.col("after"), "ratio": F.when(F.col("before") > 0, F.bround((F.col("before") - F.col("after")) / F.col("before"), 6)).otherwise(0.0)})
