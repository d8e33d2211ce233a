"""Queries on volumes, files read in parts, tiled images and keyed job state."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..model import with_sql
from ..operators import filters, freeform, incremental, kernels, runs, strokes, tiles, volumes
from ..shared import Tables
from ..sources import files, pixels, workbook
from ..streaming import jobs
from . import records

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SIDE = 24  # of a plane of the volume of events
SLAB = 64  # planes that are looked at together


# What must hold of the field: it keeps the mean of each voxel's points, and each other voxel is the mean of its neighbours.
@query("m23_volume_field", f"""WITH p AS (SELECT event_id // 40 AS z, event_id // 3 % {SIDE} AS y, event_id * 7 % {SIDE} AS x, avg(value) AS a, avg(event_id % 11) AS b FROM events GROUP BY 1, 2, 3), k AS (SELECT z, count(*) AS known, sum(a) AS sa, sum(b) AS sb FROM p GROUP BY 1)
SELECT z::INT AS z, {SIDE * SIDE}::BIGINT AS voxels, coalesce(known, 0)::BIGINT AS known, round(coalesce(sa, 0), 3) AS known_a, round(coalesce(sb, 0), 3) AS known_b, true AS harmonic FROM (SELECT unnest(range((SELECT max(z) + 1 FROM p))) AS z) LEFT JOIN k USING (z)""")
def m23_volume(spark, d):
    points = model.table(spark, d, "events").selectExpr("cast(event_id div 40 as int) z", f"cast(event_id div 3 % {SIDE} as int) y", f"cast(event_id * 7 % {SIDE} as int) x", "value a", "cast(event_id % 11 as double) b")
    planes = volumes.harmonic_planes(points, ["a", "b"], block=24, rtol=1e-6)
    # planes by slabs with the planes beside them, packed; the points' voxels meet them there
    slab = lambda z: F.floor(z / SLAB).cast("int")
    z = F.col("z")
    planes = planes.select("*", F.explode(F.array_distinct(F.array(slab(z), slab(z - 1), slab(z + 1)))).alias("slab"))
    marks = points.select("z", "y", "x", slab(z).alias("slab"))
    out = planes.groupBy("slab").cogroup(marks.groupBy("slab")).applyInArrow(_slab_summary, "z int, voxels long, known long, a double, b double, off double")
    return out.select("z", "voxels", "known", F.round("a", 3).alias("known_a"), F.round("b", 3).alias("known_b"), (F.col("off") < 0.01).alias("harmonic"))


def _slab_summary(key, planes: pa.Table, marks: pa.Table) -> pa.Table:
    """For each plane of a slab: its voxels, the known ones, the sums of the field there, and how far the field is from its neighbours' means elsewhere, times their number."""
    z = planes.column("z").to_numpy()
    first, n = int(z.min()), int(z.max() - z.min() + 1)
    f = np.full((2, n, SIDE, SIDE), np.nan)  # a voxel that is missing spoils its neighbours
    at = [planes.column(c).to_numpy() for c in ("z", "y", "x", "width")]
    for k, c in enumerate(("a", "b")):
        lists = planes.column(c).combine_chunks()
        v, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for z0, y0, x0, w, i, j in zip(*at, ends[:-1], ends[1:], strict=True):
            f[k, z0 - first, y0 : y0 + (j - i) // w, x0 : x0 + w] = v[i:j].reshape(-1, w)
    known = np.zeros(f.shape[1:], bool)
    known[tuple(marks.column(c).to_numpy() - low for c, low in (("z", first), ("y", 0), ("x", 0)))] = True
    off = np.zeros_like(f)
    for axis in (1, 2, 3):
        d = np.diff(f, axis=axis)
        ahead, behind = [slice(None)] * 4, [slice(None)] * 4
        ahead[axis], behind[axis] = slice(None, -1), slice(1, None)
        off[tuple(ahead)] += d
        off[tuple(behind)] -= d
    off = np.where(known, 0.0, np.abs(off).max(0))
    own = np.unique(z[z // SLAB == key[0].as_py()])
    f, known, off = f[:, own - first], known[own - first], off[own - first]
    a, b = np.where(known, f, 0.0).sum((2, 3))
    voxels = (~np.isnan(f[0])).sum((1, 2))
    return pa.table({"z": pa.array(own, pa.int32()), "voxels": voxels, "known": known.sum((1, 2)), "a": a, "b": b, "off": off.max((1, 2))})


def _harmonic(f, keys: list[str], columns: list[str], axes: list[str]):
    """f with _off: how far the largest of the columns is from its neighbours' mean, times their number."""
    for i, axis in enumerate(axes):
        w = Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)
        f = f.withColumns({f"_{c}{i}": F.coalesce(F.lag(c).over(w) - F.col(c), F.lit(0.0)) + F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0)) for c in columns})
    off = [F.abs(sum((F.col(f"_{c}{i}") for i in range(len(axes))), F.lit(0.0))) for c in columns]
    return f.withColumn("_off", F.greatest(*off) if len(off) > 1 else off[0])


@query("m23_plane_field", """WITH p AS (SELECT user_id AS k, event_id % 13 AS y, event_id * 7 % 16 AS x, max(value) AS value FROM events GROUP BY 1, 2, 3)
SELECT k, 256::BIGINT AS pixels, count(*) AS known, round(sum(value), 2) AS kept, true AS harmonic FROM p GROUP BY 1""")
def m23_plane(spark, d):
    p = model.table(spark, d, "events").selectExpr("user_id k", "cast(event_id % 13 as int) y", "cast(event_id * 7 % 16 as int) x", "value").groupBy("k", "y", "x").agg(F.max("value").alias("value"))
    f = kernels.laplace_field(p, ["k"], (16, 16)).join(p.select("k", "y", "x", F.lit(True).alias("_known")), ["k", "y", "x"], "left")
    k = F.coalesce("_known", F.lit(False))
    out = _harmonic(f, ["k"], ["value"], ["y", "x"]).groupBy("k").agg(F.count("*").alias("pixels"), F.count_if(k).alias("known"), F.round(F.sum(F.when(k, F.col("value")).otherwise(0.0)), 2).alias("kept"), F.max(F.when(k, 0.0).otherwise(F.col("_off"))).alias("_off"))
    return out.select("k", "pixels", "known", "kept", (F.col("_off") < 0.01).alias("harmonic"))


# Planes are vectors: eight rows of eight components.
PLANES = "v AS (SELECT vec_id AS z, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS e FROM embeddings, range(64) r(i)), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"


@query("m23_sampled_volume", f"""WITH {PLANES}, t AS (SELECT z, y, x, least(greatest(z + 3 * e, 0), n - 1) AS pz, least(greatest(y + 5 * e, 0), 7) AS py, least(greatest(x - 4 * e, 0), 7) AS px FROM v, n),
c AS (SELECT t.z, t.y, t.x, floor(pz) + a AS cz, floor(py) + b AS cy, floor(px) + c AS cx, CASE a WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END * CASE b WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE c WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END AS w
  FROM t, range(2) r(a), range(2) s(b), range(2) u(c))
SELECT c.z::INT AS z, c.y::INT AS y, c.x::INT AS x, round(sum(w * e), 6) + 0.0 AS value FROM c JOIN v ON v.z = cz AND v.y = cy AND v.x = cx WHERE w > 0 GROUP BY 1, 2, 3""")
def m23_sampled(spark, d):
    vec = model.table(spark, d, "embeddings")
    v = vec.select(F.col("vec_id").cast("int").alias("z"), F.posexplode("embedding").alias("i", "e")).selectExpr("z", "cast(i div 8 as int) y", "cast(i % 8 as int) x", "cast(e as double) e")
    depth = vec.agg(F.max("vec_id")).first()[0] + 1  # one number; the volume's shape
    field = v.selectExpr("z", "y", "x", "3 * e dz", "5 * e dy", "-4 * e dx")
    return volumes.sampled(v.withColumnRenamed("e", "value"), field, (depth, 8, 8)).withColumn("value", F.round("value", 6) + 0.0)


# ---- files read in parts -------------------------------------------------------------------------------------------------

def _written(spark, d, ending: str, encode) -> str:
    """A folder of files, one for 16 vectors: each vector is a plane of 8 x 8 values."""
    vec = model.table(spark, d, "embeddings").select((F.col("vec_id") / 16).cast("int").alias("f"), (F.col("vec_id") % 16).cast("int").alias("page"), F.col("embedding").cast("array<double>").alias("v"))

    def run(key, pdf):
        planes = [np.asarray(v, "f4").reshape(8, 8) for v in pdf.sort_values("page")["v"]]
        return pd.DataFrame({"name": [f"f{key[0]:05}{ending}"], "content": [encode(planes)]})

    folder = Tables(spark).path("files")
    pixels.write_files(vec.groupBy("f").applyInPandas(run, "name string, content binary"), folder)
    pixels.register(spark)
    return folder


def _file_number():
    return F.regexp_extract("path", r"f([0-9]{5})\.[a-z]+$", 1).cast("int")


@query("s03_tiff_pixels_source", "SELECT (vec_id // 16)::INT AS file, (vec_id % 16)::INT AS page, (i // 8)::INT AS y, (i % 8)::INT AS x, round(embedding[i + 1]::DOUBLE, 6) + 0.0 AS value FROM embeddings, range(64) r(i) WHERE vec_id % 16 IN (3, 7) AND i // 8 >= 2")
def s03(spark, d):
    px = spark.read.format("tiff_pixels").load(_written(spark, d, ".tif", files.encode_stack)).where("page in (3, 7) and y >= 2")
    return px.select(_file_number().alias("file"), "page", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query("s07_nifti_voxels_source", "SELECT (vec_id // 16)::INT AS file, (vec_id % 16)::INT AS z, round(sum(embedding[i + 1]::DOUBLE), 5) + 0.0 AS total, count(*) AS voxels FROM embeddings, range(64) r(i) WHERE vec_id % 16 BETWEEN 2 AND 5 GROUP BY 1, 2")
def s07(spark, d):
    vox = spark.read.format("nifti_voxels").load(_written(spark, d, ".nii", lambda planes: files.encode_nifti(np.stack(planes), (1.0, 1.0, 1.0)))).where("z between 2 and 5")
    return vox.groupBy(_file_number().alias("file"), "z").agg((F.round(F.sum("value"), 5) + 0.0).alias("total"), F.count("*").alias("voxels"))


# ---- keyed state ---------------------------------------------------------------------------------------------------------

@query("r08_task_state_stream", records.SQL["r08_task_states"])
def r08_stream(spark, d):
    """The events table as a stream; no event is late and no task expires, so the states are those of the batch rule. The up to 40 tasks of a user share a row of state."""
    source = spark.readStream.schema(model.table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/[e]vents.parquet")
    kind = F.when(F.col("event_id") % 11 == 0, "cancel").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "error").otherwise("progress")
    events = source.select(F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("_"), (F.col("event_id") % 40).cast("string")).alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 100).cast("int").alias("percent"), F.concat(F.lit("step "), F.col("event_id").cast("string")).alias("message"), F.col("ts").cast("timestamp").alias("at"))
    changes = jobs.run_to_end(jobs.task_stream(events, max_age_s=1e9, lateness="1000 days", group=F.regexp_extract("task_id", "^t(.*)_", 1)), Tables(spark).path("stream"))
    return jobs.latest_states(changes)


# ---- tiled images --------------------------------------------------------------------------------------------------------

def _plates(spark, d):
    """Images of 128 vectors below one another: slice_id, y, x, value."""
    vec = model.table(spark, d, "embeddings").select((F.col("vec_id") / 128).cast("int").alias("slice_id"), (F.col("vec_id") % 128).cast("int").alias("y"), F.posexplode("embedding").alias("x", "value"))
    return vec.withColumn("value", F.col("value").cast("double"))


@query("m15_tiled_components", """WITH RECURSIVE p AS MATERIALIZED (SELECT (vec_id // 128)::INT AS slice_id, (vec_id % 128)::INT AS y, i::INT AS x, (vec_id % 128) * 2147483648 + i AS id FROM embeddings, range(64) r(i) WHERE embedding[i + 1]::DOUBLE > 0.08),
e AS MATERIALIZED (SELECT a.slice_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.slice_id = b.slice_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND abs(a.y - b.y) <= 1),
r(slice_id, root, id) AS (SELECT slice_id, id, id FROM p UNION SELECT r.slice_id, r.root, e.b FROM r JOIN e ON e.slice_id = r.slice_id AND e.a = r.id), c AS (SELECT slice_id, id, min(root) AS component FROM r GROUP BY 1, 2)
SELECT slice_id, component::BIGINT AS component, count(*) AS area FROM c GROUP BY 1, 2""")
def m15_tiles(spark, d):
    return tiles.tiled_components(_plates(spark, d).where("value > 0.08"), ["slice_id"], tile=32).groupBy("slice_id", "component").agg(F.count("*").alias("area"))


@query("m16_tiled_blobs")
def m16_tiles(spark, d):
    """Held to the blobs of whole images by tests."""
    return tiles.tiled_blobs(_plates(spark, d), ["slice_id"], high=3.0, steps=4, tile=48)


# Cells of up to 10 x 10 pixels stand in a grid of 16; tiles of 64 overlap by 16, so that each cell is whole in one tile at least.
@query("m18_seam_merge", """WITH c AS (SELECT event_id AS cell, event_id // 40 * 16 + user_id % 4 AS y0, event_id % 40 * 16 + event_id * 7 % 4 AS x0, 2 + event_id % 9 AS h, 2 + user_id % 9 AS w FROM events),
t AS (SELECT *, unnest(range(greatest(0, (y0 - 16) // 48), (y0 + h - 1) // 48 + 1)) AS ty FROM c), u AS (SELECT *, unnest(range(greatest(0, (x0 - 16) // 48), (x0 + w - 1) // 48 + 1)) AS tx FROM t),
a AS (SELECT cell, ty * 100000 + tx AS tile, (least(y0 + h, ty * 48 + 64) - greatest(y0, ty * 48)) * (least(x0 + w, tx * 48 + 64) - greatest(x0, tx * 48)) AS area FROM u WHERE least(y0 + h, ty * 48 + 64) > greatest(y0, ty * 48) AND least(x0 + w, tx * 48 + 64) > greatest(x0, tx * 48))
SELECT arg_min(tile, {'a': -area, 't': tile})::BIGINT AS tile, cell::BIGINT AS cell, max(area)::BIGINT AS area, count(*) AS parts FROM a GROUP BY cell""")
def m18_seams(spark, d):
    c = model.table(spark, d, "events").selectExpr("event_id cell", "event_id div 40 * 16 + user_id % 4 y0", "event_id % 40 * 16 + event_id * 7 % 4 x0", "2 + event_id % 9 h", "2 + user_id % 9 w")
    px = c.withColumn("y", F.explode(F.expr("sequence(y0, y0 + h - 1)"))).withColumn("x", F.explode(F.expr("sequence(x0, x0 + w - 1)")))
    inside = lambda v: F.explode(F.expr(f"sequence(greatest(0, cast(ceil(({v} - 63) / 48) as bigint)), {v} div 48)"))
    masks = px.withColumn("ty", inside("y")).withColumn("tx", inside("x")).selectExpr("0 image", "ty * 100000 + tx tile", "cell", "y", "x")
    return tiles.one_of_each_cell(masks, ["image"]).select("tile", "cell", "area", "parts")


# ---- hands on images -----------------------------------------------------------------------------------------------------

# An event is a stroke on its user's image of 16 x 16 pixels, or takes one back.
@query("r18_stroke_field", """WITH RECURSIVE l AS MATERIALIZED (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type = 'signup' AS undo, {'x1': (event_id * 7 % 16)::DOUBLE, 'y1': (event_id % 13)::DOUBLE, 'dx': (event_id % 5 - 2)::DOUBLE, 'dy': (event_id % 7 - 3)::DOUBLE, 'r': 8.0::DOUBLE + event_id % 3} AS s FROM events),
h(k, i, held) AS (SELECT k, 0::BIGINT, []::STRUCT(x1 DOUBLE, y1 DOUBLE, dx DOUBLE, dy DOUBLE, r DOUBLE)[] FROM (SELECT DISTINCT k FROM l) UNION ALL SELECT h.k, l.i, CASE WHEN undo THEN held[:greatest(len(held) - 1, 0)] ELSE list_append(held, s) END FROM h JOIN l ON l.k = h.k AND l.i = h.i + 1),
b AS MATERIALIZED (SELECT k, list_filter(arg_max(held, i), lambda s: sqrt(s.dx * s.dx + s.dy * s.dy) >= 0.75) AS held FROM h GROUP BY 1),
q(k, y0, x0, n, y, x) AS (SELECT k, y, x, len(held), y::DOUBLE, x::DOUBLE FROM b, range(16) r(y), range(16) t(x) UNION ALL
  SELECT q.k, y0, x0, n - 1, q.y + held[n].dy * w, q.x + held[n].dx * w FROM q JOIN b ON b.k = q.k, LATERAL (SELECT CASE WHEN abs(q.y - held[n].y1) <= 1.65 * held[n].r AND abs(q.x - held[n].x1) <= 1.65 * held[n].r THEN 0.5 * exp(-0.5 * ((q.y - held[n].y1) ** 2 + (q.x - held[n].x1) ** 2) / greatest(4.0, 0.46 * held[n].r) ** 2) ELSE 0 END AS w) z WHERE n > 0)
SELECT k, y0::INT AS y, x0::INT AS x, round(y - y0, 5) + 0.0 AS v, round(x - x0, 5) + 0.0 AS u FROM q WHERE n = 0""")
def r18(spark, d):
    e = model.table(spark, d, "events")
    log = e.selectExpr("user_id k", "event_id seq", "case when event_type = 'signup' then 'undo' else 'drag' end kind", "event_id * 7 % 16 x1", "event_id % 13 y1", "event_id * 7 % 16 + event_id % 5 - 2 x2", "event_id % 13 + event_id % 7 - 3 y2", "8 + event_id % 3 radius", "0.5D strength")
    px = e.select(F.col("user_id").alias("k")).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    f = strokes.composed_field(px, strokes.live_strokes(log, ["k"]), ["k"])
    return f.select("k", "y", "x", (F.round("v", 5) + 0.0).alias("v"), (F.round("u", 5) + 0.0).alias("u"))


@query("r19_tissue_matte", """WITH RECURSIVE p AS MATERIALIZED (SELECT (vec_id // 128)::INT AS slice_id, (vec_id % 128)::INT AS y, i::INT AS x, embedding[i + 1]::DOUBLE AS e FROM embeddings, range(64) r(i)), b AS (SELECT slice_id, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT p.*, y = y0 OR y = y1 OR x = 0 OR x = 63 AS border FROM p JOIN b USING (slice_id)), m AS (SELECT slice_id, median(e) AS m FROM f WHERE border GROUP BY 1),
g AS MATERIALIZED (SELECT slice_id, y, x, border, abs(e - m) AS d FROM f JOIN m USING (slice_id)),
o(slice_id, y, x) AS (SELECT slice_id, y, x FROM g WHERE border AND d < 0.1 UNION SELECT g.slice_id, g.y, g.x FROM o JOIN g ON g.slice_id = o.slice_id AND abs(g.y - o.y) + abs(g.x - o.x) = 1 AND abs(g.y - o.y) <= 1 WHERE g.d < 0.1)
SELECT g.slice_id, g.y, g.x, round(CASE WHEN o.x IS NULL THEN 1.0 ELSE least(greatest((d - 0.02) / 0.08, 0), 1) END, 6) AS alpha FROM g LEFT JOIN o ON o.slice_id = g.slice_id AND o.y = g.y AND o.x = g.x""")
def r19(spark, d):
    return strokes.matte(_plates(spark, d), ["slice_id"], ["value"], low=0.02, high=0.1, tile=32).withColumn("alpha", F.round("alpha", 6))


# The moving image is the fixed one two pixels further right, as another kind of image: the field has to find that.
@query("m28_freeform_registration", "WITH p AS (SELECT (vec_id // 128)::INT AS slice_id, (vec_id % 128)::INT AS y, i::INT AS x FROM embeddings, range(64) r(i)), b AS (SELECT slice_id, max(y) AS last FROM p GROUP BY 1) SELECT slice_id, count(*) AS pixels, true AS found FROM p JOIN b USING (slice_id) WHERE y BETWEEN 8 AND last - 8 AND x BETWEEN 8 AND 55 GROUP BY 1")
def m28(spark, d):
    row = Window.partitionBy("slice_id", "y").orderBy("x")
    smooth = filters.filtered(_plates(spark, d), ["slice_id"], "gaussian", sigma=2.0)
    pairs = smooth.select("slice_id", "y", "x", F.col("value").alias("fixed"), F.exp(-8 * F.coalesce(F.lag("value", 2).over(row), F.first("value").over(row))).alias("moving"))
    last = F.max("y").over(Window.partitionBy("slice_id"))
    f = freeform.register(pairs, ["slice_id"], rounds=60).withColumn("_last", last).where("y between 8 and _last - 8 and x between 8 and 55")
    near = F.avg((F.sqrt((F.col("u") - 2) * (F.col("u") - 2) + F.col("v") * F.col("v")) < 0.5).cast("double"))
    return f.groupBy("slice_id").agg(F.count("*").alias("pixels"), (near > 0.9).alias("found"))


# ---- runs ----------------------------------------------------------------------------------------------------------------

def _similarity(kind: str) -> str:
    """The mean structural similarity of pairs `kind` (slice_id, pair, y, x, a, b) over windows of 7 x 7, as common table expressions."""
    sums = ["sum(a)", "sum(b)", "sum(a * a)", "sum(b * b)", "sum(a * b)", "count(*)"]
    row = ", ".join(f"{f} OVER r AS s{i}" for i, f in enumerate(sums))
    col = ", ".join(f"sum(s{i}) OVER c AS t{i}" for i in range(6))
    return f"""r_{kind} AS (SELECT slice_id, pair, y, x, {row} FROM {kind} WINDOW r AS (PARTITION BY slice_id, pair, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
c_{kind} AS (SELECT slice_id, pair, {col} FROM r_{kind} WINDOW c AS (PARTITION BY slice_id, pair, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
s_{kind} AS (SELECT slice_id, pair, avg((2 * t0 * t1 / 2401 + 1e-4) * (2 * (t4 - t0 * t1 / 49) / 48 + 9e-4) / ((t0 * t0 / 2401 + t1 * t1 / 2401 + 1e-4) * ((t2 - t0 * t0 / 49) / 48 + (t3 - t1 * t1 / 49) / 48 + 9e-4))) AS ssim FROM c_{kind} WHERE t5 = 49 GROUP BY 1, 2)"""


_BESIDE = lambda c, w: (f"coalesce(lag({c}) OVER {w}, {c})", f"coalesce(lead({c}) OVER {w}, {c})")
_SMOOTH = lambda c, w: f"({_BESIDE(c, w)[0]} + 2 * {c} + {_BESIDE(c, w)[1]}) / 4"
_SLOPE = lambda c, w: f"({_BESIDE(c, w)[1]} - {_BESIDE(c, w)[0]}) / 2"


@query("r17_scores_from_images", f"""WITH p AS (SELECT (vec_id // 128)::INT AS slice_id, (vec_id % 128)::INT AS y, i::INT AS x, embedding[i + 1]::DOUBLE * 100 AS e FROM embeddings, range(64) r(i)),
g AS (SELECT slice_id, y, x, e AS raw_0, coalesce(lead(e, 3) OVER r, 0) AS raw_1, coalesce(lead(e, 1) OVER r, 0) * 0.5 + e * 0.5 AS raw_2 FROM p WINDOW r AS (PARTITION BY slice_id, y ORDER BY x)),
h AS (SELECT *, {', '.join(f"{_SMOOTH(f'raw_{i}', 'r')} AS sx_{i}, {_SLOPE(f'raw_{i}', 'r')} AS dx_{i}" for i in range(3))} FROM g WINDOW r AS (PARTITION BY slice_id, y ORDER BY x)),
k AS (SELECT *, {', '.join(f"sqrt((({_SLOPE(f'sx_{i}', 'c')}) ** 2 + ({_SMOOTH(f'dx_{i}', 'c')}) ** 2) / 2) AS edge_{i}" for i in range(3))} FROM h WINDOW c AS (PARTITION BY slice_id, x ORDER BY y)),
t AS (SELECT slice_id, y, x, unnest([{', '.join(f"{{'pair': '{k}_{i}', 'a': {k}_0, 'b': {k}_{i}}}" for k in ('raw', 'edge') for i in (1, 2))}]) AS q FROM k), n AS (SELECT slice_id, q.pair AS pair, greatest(max(q.a) - min(q.a), max(q.b) - min(q.b), 1.0) AS span FROM t GROUP BY 1, 2),
pr AS (SELECT t.slice_id, q.pair AS pair, y, x, q.a / span AS a, q.b / span AS b FROM t JOIN n ON n.slice_id = t.slice_id AND n.pair = t.q.pair), {_similarity('pr')}
SELECT slice_id, round(max(ssim) FILTER (pair = 'raw_1'), 6) AS before, round(max(ssim) FILTER (pair = 'raw_2'), 6) AS after, round(max(ssim) FILTER (pair = 'edge_1'), 6) AS before_edge, round(max(ssim) FILTER (pair = 'edge_2'), 6) AS after_edge, max(ssim) FILTER (pair = 'edge_2') < max(ssim) FILTER (pair = 'edge_1') AS score_warning FROM s_pr GROUP BY 1""")
def r17(spark, d):
    row = Window.partitionBy("slice_id", "y").orderBy("x")
    e = F.col("value") * 100
    images = _plates(spark, d).select("slice_id", "y", "x", e.alias("real"), F.coalesce(F.lead(e, 3).over(row), F.lit(0.0)).alias("before"), (F.coalesce(F.lead(e, 1).over(row), F.lit(0.0)) * 0.5 + e * 0.5).alias("after"))
    return runs.score_alignment(images, ["slice_id"]).select("slice_id", *[F.round(c, 6).alias(c) for c in ("before", "after", "before_edge", "after_edge")], "score_warning")


@query("r10_incremental_run", """WITH v AS (SELECT event_id, user_id AS slice, CASE WHEN user_id = (SELECT min(user_id) FROM events) THEN value + 1 ELSE value END AS value FROM events), s AS (SELECT slice, count(*) AS n, round(sum(value), 3) AS total FROM v WHERE value > 5 GROUP BY 1)
SELECT slice, n, total, slice = (SELECT min(user_id) FROM events) AS redone FROM s""")
def r10(spark, d):
    """A first run on all events, then one with one changed slice."""
    e = model.table(spark, d, "events").selectExpr("event_id", "user_id slice", "value")
    first = e.agg(F.min("slice").alias("_least"))  # one row
    changed = e.join(F.broadcast(first), F.col("slice") == F.col("_least"), "left").select("event_id", "slice", F.when(F.col("_least").isNotNull(), F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    stages = [incremental.Stage("detect", lambda df: df.where("value > 5")), incremental.Stage("count", lambda df: df.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")))]
    run = incremental.Run(spark, Tables(spark).path("run"), "slice")
    run.all(stages, e)
    rows, told = run.all(stages, changed)
    return rows.join(told.where("stage = 'count'").select("slice", "redone"), "slice")


@query("k03_workbook_package", with_sql("structure", body=""", l AS (SELECT 'Hierarchy' AS sheet, row_number() OVER (ORDER BY graph_order, id) + 1 AS row, [id::VARCHAR, name, acronym, depth::VARCHAR] AS cells FROM structure), f AS (SELECT 'Leaf' AS sheet, row_number() OVER (ORDER BY id) + 1 AS row, [id::VARCHAR, structure_id_path] AS cells FROM structure WHERE depth = 3)
SELECT sheet, row::BIGINT AS row, array_to_string(cells, '|') AS cells FROM (SELECT * FROM l UNION ALL SELECT * FROM f UNION ALL SELECT 'Hierarchy', 1, ['id', 'name', 'acronym', 'depth'] UNION ALL SELECT 'Leaf', 1, ['id', 'structure_id_path'] UNION ALL SELECT 'RunParams', 1, ['key', 'value'] UNION ALL SELECT 'RunParams', 2, ['regions', (SELECT count(*)::VARCHAR FROM region)])"""))
def k03(spark, d):
    s = model.structure(spark, d)
    path = f"{Tables(spark).path('book')}.xlsx"
    params = model.table(spark, d, "region").agg(F.lit("regions").alias("key"), F.count("*").cast("string").alias("value"))
    workbook.write_workbook({"Hierarchy": (s.select("id", "name", "acronym", "depth", "graph_order"), ["graph_order", "id"]), "Leaf": (s.where("depth = 3").select("id", "structure_id_path"), ["id"]), "RunParams": (params, ["key"])}, path)
    book = workbook.read_workbook(spark, path)
    return book.select("sheet", "row", F.array_join(F.when(F.col("sheet") == "Hierarchy", F.slice("cells", 1, 4)).otherwise(F.col("cells")), "|").alias("cells"))
