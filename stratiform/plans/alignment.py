"""Queries on image filters, landmarks, flow, atlas candidates and detections; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..model import with_sql
from ..operators import autopick, detection, filters, flow, landmarks, placement, raster, registration, runs
from .core import greedy
from .imaging import PAIRS, SYN, _pairs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- filters ------------------------------------------------------------------------------------------------------------

EDGE = "lag({c}, 1, {c}) OVER {w}"
NEXT = "lead({c}, 1, {c}) OVER {w}"
WINDOWS = "WINDOW r AS (PARTITION BY slice_id, y ORDER BY x), c AS (PARTITION BY slice_id, x ORDER BY y)"
_lag = lambda c, w: f"coalesce(lag({c}) OVER {w}, {c})"
_lead = lambda c, w: f"coalesce(lead({c}) OVER {w}, {c})"


@query("m15_sobel", SYN + f""", a AS (SELECT slice_id, y, x, ({_lag('value', 'r')} + 2 * value + {_lead('value', 'r')}) / 4.0::DOUBLE AS sx, ({_lead('value', 'r')} - {_lag('value', 'r')}) / 2.0::DOUBLE AS dx FROM s {WINDOWS}),
b AS (SELECT slice_id, y, x, ({_lead('sx', 'c')} - {_lag('sx', 'c')}) / 2 AS h, ({_lag('dx', 'c')} + 2 * dx + {_lead('dx', 'c')}) / 4 AS w FROM a {WINDOWS}) SELECT slice_id, y, x, round(sqrt((h * h + w * w) / 2), 8) AS edge FROM b""")
def m15_sobel(spark, d):
    return filters.sobel(model.image_stack(spark, d), ["slice_id"]).withColumn("edge", F.round("edge", 8))


@query("m15_laplace", SYN + f" SELECT slice_id, y, x, value, {_lag('value', 'r')} + {_lead('value', 'r')} + {_lag('value', 'c')} + {_lead('value', 'c')} - 4 * value AS laplace FROM s {WINDOWS}")
def m15_laplace(spark, d):
    return filters.laplace(model.image_stack(spark, d), ["slice_id"])


@query("m15_gaussian", SYN + """, k AS (SELECT o::INT AS o, exp(-0.5::DOUBLE * o * o) / (SELECT sum(exp(-0.5::DOUBLE * p * p)) FROM range(-4, 5) u(p)) AS w FROM range(-4, 5) t(o)),
a AS (SELECT s.slice_id, s.y, t.x, sum(w * s.value) AS v FROM (SELECT DISTINCT x FROM s) t, k, s WHERE s.x = CASE WHEN t.x + o < 0 THEN -1 - t.x - o WHEN t.x + o > 63 THEN 127 - t.x - o ELSE t.x + o END GROUP BY 1, 2, 3)
SELECT a.slice_id, t.y, a.x, round(sum(w * v), 6) AS value FROM (SELECT DISTINCT y FROM s) t, k, a WHERE a.y = CASE WHEN t.y + o < 0 THEN -1 - t.y - o WHEN t.y + o > 63 THEN 127 - t.y - o ELSE t.y + o END GROUP BY 1, 2, 3""")
def m15_gaussian(spark, d):
    return filters.filtered(model.image_stack(spark, d), ["slice_id"], "gaussian", sigma=1.0).withColumn("value", F.round("value", 6))


MASK = SYN + ", b AS (SELECT slice_id, y, x, value > 118 AS on_ FROM s), p AS (SELECT slice_id, y, x FROM b WHERE on_), o AS (SELECT dy, dx FROM range(-2, 3) t(dy), range(-2, 3) u(dx) WHERE dy * dy + dx * dx <= 4)"
GROWN = MASK + ", g AS (SELECT DISTINCT slice_id, y + dy AS y, x + dx AS x, 1.0::DOUBLE AS hit FROM p, o)"


def _mask(spark, d):
    return model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "cast(value > 118 as double) value")


@query("m15_dilate", GROWN + " SELECT slice_id, y, x, coalesce(hit, 0) AS value FROM b LEFT JOIN g USING (slice_id, y, x)")
def m15_dilate(spark, d):
    return filters.filtered(_mask(spark, d), ["slice_id"], "dilate", radius=2)


@query("m15_closing", GROWN + """, n AS (SELECT slice_id, b.y + dy AS y, b.x + dx AS x FROM b, o), m AS (SELECT slice_id, y, x, coalesce(hit, 0) AS v FROM b LEFT JOIN g USING (slice_id, y, x)), z AS (SELECT DISTINCT m.slice_id, m.y + dy AS y, m.x + dx AS x, 1 AS off_ FROM m, o WHERE v = 0)
SELECT slice_id, y, x, CASE WHEN off_ = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM m LEFT JOIN z USING (slice_id, y, x)""")
def m15_closing(spark, d):
    return filters.filtered(_mask(spark, d), ["slice_id"], "closing", radius=2)


@query("m15_distance", MASK + " SELECT b.slice_id, b.y, b.x, round(min(sqrt((b.y - p.y) * (b.y - p.y) + (b.x - p.x) * (b.x - p.x))), 8) AS value FROM b JOIN p USING (slice_id) GROUP BY 1, 2, 3")
def m15_distance(spark, d):
    return filters.filtered(_mask(spark, d), ["slice_id"], "distance").withColumn("value", F.round("value", 8))


@query("m15_inner_boundaries", SYN + """, l AS (SELECT slice_id, y, x, value // 60 AS v FROM s) SELECT a.slice_id, a.y, a.x, a.v > 0 AND bool_or(b.v > 0 AND b.v <> a.v) AS inner FROM l a JOIN l b ON a.slice_id = b.slice_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.slice_id, a.y, a.x, a.v""")
def m15_inner(spark, d):
    return filters.inner_boundaries(model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "cast(value div 60 as int) region_id"), ["slice_id"])


@query("m15_canny")
def m15_canny(spark, d):
    return filters.filtered(model.image_stack(spark, d), ["slice_id"], "canny", sigma=1.0, low=10.0, high=25.0).where("value > 0")


@query("m15_equalise", SYN + """, l AS (SELECT slice_id, y, x, least(greatest(floor(least(value, 255) / 255.0::DOUBLE * 256), 0), 255)::INT AS level, y // 16 AS ty, x // 16 AS tx FROM s),
c AS (SELECT slice_id, ty, tx, level, count(*)::DOUBLE AS n FROM l GROUP BY ALL), e AS (SELECT slice_id, ty, tx, sum(greatest(n - 2.56::DOUBLE, 0)) / 256 AS more FROM c GROUP BY ALL),
m AS MATERIALIZED (SELECT e.slice_id, e.ty, e.tx, b.level, sum(least(coalesce(n, 0), 2.56::DOUBLE) + more) OVER (PARTITION BY e.slice_id, e.ty, e.tx ORDER BY b.level) / 256 AS m FROM e CROSS JOIN range(256) b(level) LEFT JOIN c ON c.slice_id = e.slice_id AND c.ty = e.ty AND c.tx = e.tx AND c.level = b.level),
p AS (SELECT slice_id, y, x, level, greatest(0, least(3, (y - 7.5::DOUBLE) / 16)) AS py, greatest(0, least(3, (x - 7.5::DOUBLE) / 16)) AS px FROM l),
q AS (SELECT p.slice_id, y, x, m * CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END AS part FROM p, range(2) a(dy), range(2) b(dx), m WHERE m.slice_id = p.slice_id AND m.level = p.level AND m.ty = least(floor(py) + dy, 3) AND m.tx = least(floor(px) + dx, 3))
SELECT slice_id, y, x, round(sum(part) + 1e-9, 6) AS value FROM q GROUP BY ALL""")
def m15_equalise(spark, d):
    return filters.filtered(model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "least(value, 255) / 255.0D value"), ["slice_id"], "equalise", tiles=4).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("m15_tissue")
def m15_tissue(spark, d):
    return filters.detect_tissue(model.label_raster(spark, d).selectExpr("slice_id", "y", "x", "cast(region_id as double) value"), ["slice_id"])


# ---- landmarks -------------------------------------------------------------------------------------------------------------

@query("m11_displacement_cut", " WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 20 AS g, l_quantity - 20 AS dy, (l_partkey % 61 - 30)::DOUBLE AS dx FROM lineitem), q AS (SELECT g, greatest(10.0, quantile_cont(abs(dy), 0.9)) AS ly, greatest(10.0, quantile_cont(abs(dx), 0.9)) AS lx FROM p GROUP BY 1) SELECT o, n, g FROM p JOIN q USING (g) WHERE abs(dy) < ly AND abs(dx) < lx")
def m11(spark, d):
    p = model.table(spark, d, "lineitem").selectExpr("l_orderkey o", "l_linenumber n", "l_suppkey % 20 g", "l_quantity - 20 dy", "cast(l_partkey % 61 - 30 as double) dx")
    return landmarks.displacement_cut(p, ["g"], ["dy", "dx"]).select("o", "n", "g")


@query("k11_boundary_conditions", " SELECT (l_orderkey % 97)::FLOAT AS fx, (l_partkey % 89)::FLOAT AS fy, (l_suppkey % 83)::FLOAT AS fz, (l_orderkey % 97 + l_tax)::FLOAT AS mx, l_quantity::FLOAT AS my, (l_discount * 100)::FLOAT AS mz, (l_quantity - l_partkey % 89)::FLOAT AS disp_y, (l_discount * 100 - l_suppkey % 83)::FLOAT AS disp_z FROM lineitem")
def k11(spark, d):
    return landmarks.boundary_conditions(model.table(spark, d, "lineitem").selectExpr("l_orderkey % 97 fx", "l_partkey % 89 fy", "l_suppkey % 83 fz", "l_orderkey % 97 + l_tax mx", "l_quantity my", "l_discount * 100 mz"))


@query("f14_ap_range", """ WITH f AS (SELECT user_id AS run, CASE WHEN event_id % 5 = 0 AND user_id % 7 = 0 THEN 'overview' ELSE 'z' || lpad((event_id % 3000)::VARCHAR, 4, '0') END AS s FROM events), e AS (SELECT run, try_cast(substr(min(s), 2) AS INT) AS a, try_cast(substr(max(s), 2) AS INT) AS b FROM f GROUP BY 1)
SELECT run, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE greatest(0, trunc(a * 0.2::DOUBLE)::INT + 120 - 5) END AS ap_start, CASE WHEN a IS NULL OR b IS NULL THEN 528 ELSE least(528, trunc(b * 0.2::DOUBLE)::INT + 120 + 5) END AS ap_end FROM e""")
def f14(spark, d):
    e = model.table(spark, d, "events")
    name = F.when((F.col("event_id") % 5 == 0) & (F.col("run") % 7 == 0), "overview").otherwise(F.concat(F.lit("z"), F.lpad((F.col("event_id") % 3000).cast("string"), 4, "0")))
    return landmarks.ap_range(e.withColumnRenamed("user_id", "run"), ["run"], name, 0.2, 120)


@query("j14_aligned_report", with_sql("slice_qc", body=""", r AS (SELECT series, list(slice_id ORDER BY slice_id) AS ids, list(best_z + 1 ORDER BY slice_id) AS z, list(best_z / 10.0::DOUBLE ORDER BY slice_id) AS dev FROM slice_qc WHERE slice_id % 3 <> 0 GROUP BY 1),
i AS (SELECT series, unnest(ids) AS slice_id, unnest(range(1, len(ids) + 1)) AS i, z, dev FROM r)
SELECT q.series, q.slice_id, best_z AS original_z, CASE WHEN i IS NULL THEN best_z WHEN i <= len(z) - 2 THEN z[i] ELSE 0 END::INT AS smoothed_z, coalesce(dev[i], 0.0) AS deviation, coalesce(i % 2 = 0, false) AS is_outlier, registration_ok FROM slice_qc q LEFT JOIN i USING (series, slice_id)"""))
def j14(spark, d):
    qc = model.slice_qc(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("slice_id", "best_z")))
    r = qc.where("slice_id % 3 <> 0").groupBy("series").agg(rows.alias("r"))
    z = F.transform("r", lambda x: x["best_z"] + 1)
    report = r.select("series", F.transform("r", lambda x: x["slice_id"]).alias("slice_ids"), F.slice(z, 1, F.greatest(F.size(z) - 2, F.lit(0))).alias("smoothed_z"), F.transform("r", lambda x: x["best_z"] / 10.0).alias("deviation"), F.transform("r", lambda x, i: i % 2 == 1).alias("is_outlier"))
    return landmarks.with_report(qc, report, ["series"])


CONTOUR = " WITH p AS (SELECT p_size AS contour, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS ord, (p_partkey * 7 % 200)::INT AS x, (p_partkey * 13 % 150)::INT AS y, count(*) OVER (PARTITION BY p_size) AS n FROM part)"


@query("w11_contour_average", CONTOUR + """, t AS (SELECT *, ord + k * n AS pos FROM p, range(0, 12) r(k) WHERE k <= ceil(8 / n)), a AS (SELECT *, avg(x) OVER w AS ax, avg(y) OVER w AS ay FROM t WINDOW w AS (PARTITION BY contour ORDER BY pos ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))
SELECT contour, ord, CASE WHEN n < 6 THEN x ELSE round_even(ax, 0)::INT END AS x, CASE WHEN n < 6 THEN y ELSE round_even(ay, 0)::INT END AS y FROM a WHERE k = 0""")
def w11(spark, d):
    from pyspark.sql import Window

    p = model.table(spark, d, "part").withColumn("ord", (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).cast("int"))
    return landmarks.contour_average(p.selectExpr("p_size contour", "ord", "cast(p_partkey * 7 % 200 as int) x", "cast(p_partkey * 13 % 150 as int) y"), ["contour"], 9)


@query("m21_similarity_fit", PAIRS + """, q AS (SELECT pair, (i % 8)::DOUBLE AS x, (i // 8)::DOUBLE AS y, 2 * (i % 8) - (i // 8) + a AS u, (i % 8) + 2 * (i // 8) + b AS v FROM p), s AS (SELECT pair, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, (covar_pop(x, u) + covar_pop(y, v)) / (var_pop(x) + var_pop(y)) AS a, (covar_pop(x, v) - covar_pop(y, u)) / (var_pop(x) + var_pop(y)) AS b FROM q GROUP BY 1)
SELECT pair, round(sqrt(a * a + b * b), 7) AS scale, round(atan2(b, a), 7) AS angle, round(mu - a * mx + b * my, 6) AS dx, round(mv - b * mx - a * my, 6) AS dy FROM s""")
def m21s(spark, d):
    q = _pairs(spark, d).selectExpr("pair", "cast(x as double) x", "cast(y as double) y", "2 * x - y + a u", "x + 2 * y + b v")
    return landmarks.similarity_fit(q, ["pair"]).select("pair", F.round("scale", 7).alias("scale"), F.round("angle", 7).alias("angle"), F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("m21_fit_scale", " WITH b AS (SELECT s_suppkey AS k, 100 + s_suppkey % 37 AS th, 80 + s_suppkey % 53 AS tw, 40 + s_suppkey % 11 AS ah, 30 + s_suppkey % 13 AS aw, 1.5::DOUBLE AS p FROM supplier), f AS (SELECT k, p, th / greatest(ah * p, 1) AS h, tw / greatest(aw * p, 1) AS w FROM b) SELECT k, round(p * least(h, w), 9) AS contain, round(p * greatest(h, w), 9) AS cover, round(p * sqrt(h * w), 9) AS mean FROM f")
def m21f(spark, d):
    b = model.table(spark, d, "supplier").selectExpr("s_suppkey k", "100 + s_suppkey % 37 th", "80 + s_suppkey % 53 tw", "40 + s_suppkey % 11 ah", "30 + s_suppkey % 13 aw")
    fit = lambda m: F.round(landmarks.fit_scale(F.col("th"), F.col("tw"), F.col("ah"), F.col("aw"), F.lit(1.5), m), 9)
    return b.select("k", fit("contain").alias("contain"), fit("cover").alias("cover"), fit("mean").alias("mean"))


def _landmarks(spark, d):
    """Five fixed landmarks a slice, moved by the slice's number."""
    s = model.image_stack(spark, d).select("slice_id").distinct()
    at = [(4, 5), (58, 6), (57, 59), (5, 57), (31, 30)]
    pts = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("atlas_x"), F.lit(float(y)).alias("atlas_y")) for x, y in at]))
    return s.select("slice_id", pts.alias("p")).select("slice_id", "p.*").withColumns({"real_x": F.col("atlas_x") + F.col("slice_id") % 5, "real_y": F.col("atlas_y") - F.col("slice_id") % 3})


@query("m21_affine_warp", SYN + " SELECT a.slice_id, a.y, a.x, coalesce(b.value, 0)::INT AS region_id FROM s a LEFT JOIN s b ON a.slice_id = b.slice_id AND b.x = a.x - a.slice_id % 5 AND b.y = a.y + a.slice_id % 3")
def m21w(spark, d):
    return landmarks.landmark_warp(model.image_stack(spark, d).withColumnRenamed("value", "region_id"), _landmarks(spark, d), ["slice_id"], (64, 64))


@query("m21_piecewise_warp")
def m21p(spark, d):
    return landmarks.landmark_warp(model.image_stack(spark, d).withColumnRenamed("value", "region_id"), _landmarks(spark, d), ["slice_id"], (64, 64), "piecewise")


@query("m21_spline_warp", SQL["m21_affine_warp"])  # the spline of a shift is the shift
def m21t(spark, d):
    return landmarks.landmark_warp(model.image_stack(spark, d).withColumnRenamed("value", "region_id"), _landmarks(spark, d), ["slice_id"], (64, 64), "spline")


@query("m25_landmarks")
def m25(spark, d):
    px = model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "cast(value as double) real", "cast(value as double) + 3 atlas")
    return landmarks.propose_landmarks(px, ["slice_id"], distance=6)


@query("m30_colored_outlines", with_sql("label_raster", body=""", k AS (SELECT *, region_id % 2 = 0 AS own, region_id::BIGINT * 2654435761 & 16777215 AS v, region_id > 0 AND (coalesce(lead(region_id) OVER r <> region_id, false) OR coalesce(lag(region_id) OVER r <> region_id, false) OR coalesce(lead(region_id) OVER c <> region_id, false) OR coalesce(lag(region_id) OVER c <> region_id, false)) AS line FROM label_raster WINDOW r AS (PARTITION BY slice_id, y ORDER BY x), c AS (PARTITION BY slice_id, x ORDER BY y)),
p AS (SELECT slice_id, CASE WHEN line THEN 255 WHEN region_id = 0 THEN 0 WHEN own THEN region_id % 256 ELSE (v >> 16)::INT END AS r, CASE WHEN line THEN 255 WHEN region_id = 0 THEN 0 WHEN own THEN 10 ELSE (v >> 8 & 255)::INT END AS g, CASE WHEN line THEN 255 WHEN region_id = 0 THEN 0 WHEN own THEN 20 ELSE (v & 255)::INT END AS b FROM k) SELECT slice_id, r, g, b, count(*) AS pixels FROM p GROUP BY ALL"""))
def m30(spark, d):
    raster_ = model.label_raster(spark, d)
    colors = raster_.where("region_id % 2 = 0 and region_id > 0").select("region_id").distinct().selectExpr("region_id", "region_id % 256 r", "10 g", "20 b")
    out = raster.outlined(raster.colorize(raster_, colors), ["slice_id"])
    return out.groupBy("slice_id", "r", "g", "b").agg(F.count("*").alias("pixels"))


# ---- candidates and refinement -----------------------------------------------------------------------------------------------

PLANES = " WITH z AS (SELECT z::INT AS z, list_transform(range(64), lambda i: (i * (z + 3) + z * z) % 7 < 3) AS mask FROM range(0, 96) t(z)), im AS (SELECT vec_id AS image, list_transform(embedding, lambda v: v > 0) AS own FROM embeddings)"


def _planes(spark):
    z = spark.range(96).selectExpr("cast(id as int) z")
    return z.withColumn("mask", F.expr("transform(sequence(0, 63), i -> (i * (z + 3) + z * z) % 7 < 3)"))


@query("j17_best_plane", PLANES + """, j AS (SELECT image, z, list_zip(own, mask) AS m FROM im, z WHERE z % 2 = 0 AND z < 90), s AS (SELECT image, z, round(len(list_filter(m, lambda p: p[1] AND p[2])) / (len(list_filter(m, lambda p: p[1] OR p[2])) + 1e-6::DOUBLE), 9) AS s FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY s DESC, z) AS r FROM s) SELECT image, (min(z) FILTER (r = 1))::INT AS best_z, max(s) AS best_score, list(z ORDER BY r)::VARCHAR AS coarse_top FROM r WHERE r <= 8 GROUP BY 1""")
def j17(spark, d):
    im = model.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda v: v > 0).alias("own"))
    out = autopick.best_plane(im, _planes(spark), F.round(autopick.overlap("own", "mask"), 9), step=2, z_range=(0, 90))
    return out.withColumn("coarse_top", F.col("coarse_top").cast("string"))


@query("j17_refine_by_size", PLANES + """, a AS (SELECT z, mask, (z * 37 % 60)::INT AS area FROM z), i AS (SELECT image, own, (image % 100)::INT AS e, 5.0::DOUBLE + image % 50 AS ia FROM im),
n AS (SELECT image, z, e, round(CASE WHEN area < 10 THEN 0.0 ELSE least(ia, area) / greatest(ia, area) END, 12) AS q, list_zip(own, mask) AS m FROM i JOIN a ON z BETWEEN greatest(0, e - 12) AND e + 12 AND (z - greatest(0, e - 12)) % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY q DESC, z) AS r FROM n), s AS (SELECT image, z, r, round(pow(q, 1.5) * greatest(len(list_filter(m, lambda p: p[1] AND p[2])) / (len(list_filter(m, lambda p: p[1] OR p[2])) + 1e-6::DOUBLE), 0), 9) AS s FROM r WHERE r <= 8),
b AS (SELECT image, arg_max(z, {'s': s, 'r': -r}) AS best_z, max(s) AS best_score FROM s GROUP BY 1) SELECT image, coalesce(best_z, e)::INT AS best_z, coalesce(best_score, 0) AS best_score FROM i LEFT JOIN b USING (image)""")
def j17b(spark, d):
    im = model.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda v: v > 0).alias("own"), (F.col("vec_id") % 100).cast("int").alias("z_estimate"), (5.0 + F.col("vec_id") % 50).alias("image_area"))
    planes = _planes(spark).withColumn("plane_area", (F.col("z") * 37 % 60).cast("int"))
    out = autopick.refine_by_size(im, planes, autopick.overlap("own", "mask"), reach=12)
    return out.withColumn("best_score", F.round("best_score", 9))


def _refine(spark, d, method, **p):
    """Every 8th image's block pattern, its outline shifted by the slice's number: the true image is the pattern."""
    px = model.image_stack(spark, d).selectExpr("slice_id", "y", "x")
    inside = "(x - 32) * (x - 32) + (y - 32) * (y - 32) < 576"
    moved = "(x - 32 - slice_id % 5) * (x - 32 - slice_id % 5) + (y - 32) * (y - 32) < 576"
    px = px.selectExpr("slice_id", "y", "x", f"case when {inside} then case when x < 32 then 200.0D else 120.0D end else 5.0D end real", f"case when {moved} then case when x < 32 + slice_id % 5 then 1 else 2 end else 0 end region_id", f"cast({inside} as double) tissue")
    return flow.refine(px, ["slice_id"], (method,), **{method: p})


@query("m33_flow_refinement")
def m33(spark, d):
    return _refine(spark, d, "flow", steps=20)


@query("m34_liquify_refinement")
def m34(spark, d):
    return _refine(spark, d, "liquify")


@query("m36_silhouette_refinement")
def m36(spark, d):
    return _refine(spark, d, "silhouette", size=64, steps=20)


@query("m35_external_guard", " WITH c AS (SELECT s_suppkey AS k, s_suppkey % 100 / 100.0::DOUBLE AS mb, s_suppkey * 7 % 100 / 100.0::DOUBLE AS ma, s_suppkey % 50 / 10.0::DOUBLE AS ib, s_suppkey * 3 % 50 / 10.0::DOUBLE AS ia FROM supplier) SELECT k, ma >= mb - 0.006::DOUBLE AND ia >= ib * (1 - 0.012::DOUBLE) AS accepted FROM c")
def m35(spark, d):
    from ..operators import selection

    c = model.table(spark, d, "supplier").selectExpr("s_suppkey k", "s_suppkey % 100 / 100.0D mb", "s_suppkey * 7 % 100 / 100.0D ma", "s_suppkey % 50 / 10.0D ib", "s_suppkey * 3 % 50 / 10.0D ia")
    return c.select("k", selection.accept_external(F.col("mb"), F.col("ma"), F.col("ib"), F.col("ia")).alias("accepted"))


# ---- detections ---------------------------------------------------------------------------------------------------------------

@query("m18_merge_tiles", " SELECT event_id, (event_id % 300 + event_id % 4 * 320)::DOUBLE AS x, (user_id % 300 + user_id % 3 * 320)::DOUBLE AS y FROM events")
def m18(spark, d):
    e = model.table(spark, d, "events").selectExpr("event_id", "cast(event_id % 300 as double) x", "cast(user_id % 300 as double) y", "event_id % 4 * 320 tile_x", "user_id % 3 * 320 tile_y")
    return detection.merge_tiles(e)


def _found(spark, d):
    p = model.points(spark, d).where("detector is not null")
    return p.where("detector = 'view' and slice_id % 3 <> 0"), p.where("detector = 'click'"), p.where("detector = 'signup'")


@query("m20_dispatch", with_sql("points", body=""",
f AS (SELECT slice_id, x, y, score, detector, CASE detector WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS source FROM points WHERE detector = 'view' AND slice_id % 3 <> 0 OR detector IN ('click', 'signup')),
u AS (SELECT f.*, row_number() OVER (PARTITION BY f.slice_id ORDER BY score DESC, x, y) AS sc FROM f JOIN (SELECT slice_id, min(source) AS source FROM f GROUP BY 1) USING (slice_id, source)),
n AS (SELECT b.slice_id, b.sc, list(a.sc) AS near FROM u a JOIN u b ON a.slice_id = b.slice_id AND a.sc <> b.sc AND ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 16.0::DOUBLE <= 1.0 GROUP BY 1, 2),
o AS (SELECT u.*, CASE WHEN source = 2 THEN [] ELSE coalesce(near, []) END AS near FROM u LEFT JOIN n USING (slice_id, sc)),
g(slice_id, k, kept) AS (SELECT DISTINCT slice_id, 0::BIGINT, []::BIGINT[] FROM o UNION ALL SELECT g.slice_id, o.sc, CASE WHEN list_has_any(g.kept, o.near) THEN g.kept ELSE list_append(g.kept, o.sc) END FROM g JOIN o ON o.slice_id = g.slice_id AND o.sc = g.k + 1),
l AS (SELECT slice_id, unnest(arg_max(kept, k)) AS sc FROM g GROUP BY 1)
SELECT row_number() OVER (PARTITION BY slice_id ORDER BY sc) AS cell_id, slice_id, x, y, score, detector FROM o JOIN l USING (slice_id, sc)""").replace("WITH ", "WITH RECURSIVE ", 1))
def m20(spark, d):
    return detection.dispatch(*_found(spark, d), allow_fallback=True)


@query("r09_detection_summary", greedy(""", b AS (SELECT count(*) AS n, '{' || string_agg('"' || dt || '": ' || c, ', ' ORDER BY dt) || '}' AS t FROM (SELECT coalesce(detector, 'unknown') AS dt, count(*) AS c FROM points GROUP BY 1)),
a AS (SELECT count(*) AS n, '{' || string_agg('"' || dt || '": ' || c, ', ' ORDER BY dt) || '}' AS t FROM (SELECT coalesce(detector, 'unknown') AS dt, count(*) AS c FROM points JOIN l USING (cell_id) GROUP BY 1))
SELECT (SELECT count(*) FROM points) AS cells_detected, b.t AS detector_counts, (SELECT count(*) FROM l) AS cells_dedup, a.t AS dedup_detector_counts, 'merged' AS sampling_mode, 5 AS slice_interval_n, 'cellpose_cyto2' AS primary_model, '' AS secondary_model, true AS requested_instance_segmentation, false AS allow_fallback FROM a, b"""))
def r09(spark, d):
    from ..operators import dedup

    p = model.points(spark, d)
    kept = dedup.thin(p, r_xy=6.0, group=["slice_id"]).where("kept")
    return detection.summary(p, kept, sampling_mode="merged", interval=5, primary="cellpose_cyto2")


@query("r11_volume_summary", with_sql("label_raster", body=""", v AS (SELECT slice_id, region_id AS a, ((x * 7 + y * 13 + slice_id) % 100) / 100.0::DOUBLE AS r, ((x * 7 + y * 13 + slice_id * 3) % 100) / 100.0::DOUBLE AS t FROM label_raster)
SELECT slice_id, count(*) AS n, round(corr(r, t), 6) AS ncc, round(avg((r - t) * (r - t)), 9) AS mse, count(*) FILTER (a > 0) AS atlas_voxels, count(*) FILTER (a > 0 AND r > .02) AS covered_voxels FROM v GROUP BY 1"""))
def r11(spark, d):
    v = model.label_raster(spark, d).selectExpr("slice_id", "region_id annotation", "(x * 7 + y * 13 + slice_id) % 100 / 100.0D registered", "(x * 7 + y * 13 + slice_id * 3) % 100 / 100.0D template")
    return runs.volume_summary(v, ["slice_id"]).select("slice_id", "n", F.round("ncc", 6).alias("ncc"), F.round("mse", 9).alias("mse"), "atlas_voxels", "covered_voxels")


@query("m03_ncc_by_slice", PAIRS + " SELECT pair, round(corr(a, b), 6) AS ncc FROM p GROUP BY 1")
def m03(spark, d):
    return registration.similarity(_pairs(spark, d), ["pair"]).select("pair", F.round("ncc", 6).alias("ncc"))


# ---- placement -------------------------------------------------------------------------------------------------------------------

@query("m27_hemisphere_images", with_sql("label_raster", body=""", l AS (SELECT * FROM label_raster WHERE region_id > 0), b AS (SELECT slice_id, (min(x) + max(x) + 1) // 2 AS mid FROM l GROUP BY 1), j AS (SELECT l.*, mid, 511 - x AS f FROM l JOIN b USING (slice_id)),
c AS (SELECT slice_id, 'full' AS candidate, y, x, region_id FROM j UNION ALL SELECT slice_id, 'left', y, x, region_id FROM j WHERE x < mid UNION ALL SELECT slice_id, 'right_mirrored', y, f, region_id FROM j WHERE f < mid UNION ALL SELECT slice_id, 'right_orig', y, x, region_id FROM j WHERE x >= mid UNION ALL SELECT slice_id, 'right_flipped', y, f, region_id FROM j WHERE x >= mid)
SELECT slice_id, candidate, region_id, count(*) AS pixels, sum(x)::BIGINT AS x_sum, min(x)::INT AS x0, max(x)::INT AS x1 FROM c GROUP BY 1, 2, 3"""))
def m27_images(spark, d):
    c = placement.hemispheres(model.label_raster(spark, d), ["slice_id"], model.WIDTH)
    return c.groupBy("slice_id", "candidate", "region_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("x_sum"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query("m38_area_placement", with_sql("label_raster", body=""", l AS (SELECT * FROM label_raster WHERE region_id > 10003), x AS (SELECT slice_id, quantile_cont(x, 0.02) AS l, quantile_cont(x, 0.98) AS r FROM (SELECT DISTINCT slice_id, x FROM l) GROUP BY 1), y AS (SELECT slice_id, quantile_cont(y, 0.02) AS t, quantile_cont(y, 0.98) AS b FROM (SELECT DISTINCT slice_id, y FROM l) GROUP BY 1),
t AS (SELECT slice_id, avg((x * 7 + y * 13) % 50) + 4 * stddev_pop((x * 7 + y * 13) % 50) AS threshold FROM label_raster WHERE x < 80 AND (y < 80 OR y >= 432) GROUP BY 1), a AS (SELECT slice_id, count(*) AS n FROM l GROUP BY 1)
SELECT slice_id, l AS "left", r AS "right", t AS top, b AS bottom, round(threshold, 6) AS threshold, round(least(1.5, greatest(0.5, sqrt(n / greatest(90000 * 0.8::DOUBLE * 0.8::DOUBLE, 1)))), 9) AS scale FROM x JOIN y USING (slice_id) JOIN t USING (slice_id) JOIN a USING (slice_id)"""))
def m38_area(spark, d):
    r = model.label_raster(spark, d)
    mask = r.where("region_id > 10003")
    box = placement.occupied_box(mask, ["slice_id"])
    cut = placement.corner_threshold(r.selectExpr("slice_id", "y", "x", "(x * 7 + y * 13) % 50 value"), ["slice_id"], model.HEIGHT)
    area = mask.groupBy("slice_id").agg(F.count("*").alias("n"))
    out = box.join(cut, "slice_id").join(area, "slice_id")
    return out.select("slice_id", "left", "right", "top", "bottom", F.round("threshold", 6).alias("threshold"), F.round(placement.area_scale(F.col("n"), F.lit(90000), 0.8), 9).alias("scale"))


def _placed(spark, d):
    """A two-part disc in a 64 x 64 image of tissue, and its label moved by the slice's number."""
    px = model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "(x - 32) * (x - 32) + (y - 32) * (y - 32) < 484 t", "(x - 32 - slice_id % 4) * (x - 32 - slice_id % 4) + (y - 32) * (y - 32) < 484 l")
    return px.selectExpr("slice_id", "y", "x", "case when t then case when x < 32 then 220.0D else 90.0D end else 2.0D end real", "case when l then case when x < 32 + slice_id % 4 then 1 else 2 end else 0 end region_id", "cast(t as double) tissue")


@query("m32_similarity_fit")
def m32(spark, d):
    return placement.fit_similarity(_placed(spark, d), ["slice_id"], stride=1)


@query("m37_contour_conform")
def m37_conform(spark, d):
    return placement.conform(_placed(spark, d), ["slice_id"]).groupBy("slice_id", "region_id").agg(F.count("*").alias("pixels"))


@query("m26_label_cleanup")
def m26(spark, d):
    r = model.label_raster(spark, d).selectExpr("slice_id", "y", "x", "case when (x * 31 + y * 17) % 97 = 0 then 0 when (x * 13 + y * 29) % 211 = 0 and region_id > 0 then 10099 else region_id end region_id", "cast(region_id > 0 as double) tissue")
    return placement.clean_labels(r, ["slice_id"]).groupBy("slice_id", "region_id").agg(F.count("*").alias("pixels"))


@query("m26_small_islands")
def m26_islands(spark, d):
    from ..operators import kernels

    return kernels.remove_islands(model.label_raster(spark, d), ["slice_id"], 60).groupBy("slice_id", "region_id").agg(F.count("*").alias("n"))


@query("m24_oriented_normals")
def m24_oriented(spark, d):
    p = _placed(spark, d)
    mask = p.selectExpr("slice_id", "y", "x", "tissue value")
    edge = filters.sobel(mask, ["slice_id"]).where("edge > 0.2").select("slice_id", "y", "x")
    return placement.oriented_normals(mask, edge, ["slice_id"], 4.0)
