"""Queries on array kernels and on pipelines as a whole; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..model import with_sql
from ..operators import flow, kernels, mapping, placement, selection
from . import core
from .core import MAPPED
from .imaging import PAIRS, SYN, _pairs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("m06_ssim", PAIRS + """, g AS (SELECT pair, (i // 8)::INT AS y, (i % 8)::INT AS x, a, b FROM p), w AS (SELECT c.pair, c.y, c.x, avg(n.a) AS ma, avg(n.b) AS mb, covar_samp(n.a, n.b) AS cab, var_samp(n.a) AS va, var_samp(n.b) AS vb FROM (SELECT pair, y, x FROM g WHERE y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4) c JOIN g n ON n.pair = c.pair AND abs(n.y - c.y) <= 3 AND abs(n.x - c.x) <= 3 GROUP BY 1, 2, 3)
SELECT pair, round(avg((2 * ma * mb + 1e-4::DOUBLE) * (2 * cab + 9e-4::DOUBLE) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))), 6) AS ssim FROM w GROUP BY 1""")
def m06(spark, d):
    return kernels.ssim(_pairs(spark, d), ["pair"]).withColumn("ssim", F.round("ssim", 6))


@query("m08_boundary_f1", with_sql("label_raster", body=""", r AS (SELECT slice_id, y, x, region_id AS v, (CASE WHEN x % 9 = 0 THEN 0 ELSE region_id END) AS w FROM label_raster),
b AS MATERIALIZED (SELECT slice_id, y, x, y < 511 AND x < 511 AND (v <> lead(v) OVER a OR v <> lead(v) OVER c) AS pa, y < 511 AND x < 511 AND (w <> lead(w) OVER a OR w <> lead(w) OVER c) AS pb FROM r WINDOW a AS (PARTITION BY slice_id, y ORDER BY x), c AS (PARTITION BY slice_id, x ORDER BY y)),
pa AS (SELECT slice_id, y, x FROM b WHERE pa), pb AS (SELECT slice_id, y, x FROM b WHERE pb), o AS (SELECT dy, dx FROM range(-2, 3) t(dy), range(-2, 3) u(dx)),
ga AS MATERIALIZED (SELECT DISTINCT slice_id, y + dy AS y, x + dx AS x, 1 AS hit FROM pa, o), gb AS MATERIALIZED (SELECT DISTINCT slice_id, y + dy AS y, x + dx AS x, 1 AS hit FROM pb, o),
p AS (SELECT slice_id, count(hit)::DOUBLE / count(*) AS pr FROM pa LEFT JOIN gb USING (slice_id, y, x) GROUP BY 1), q AS (SELECT slice_id, count(hit)::DOUBLE / count(*) AS rc FROM pb LEFT JOIN ga USING (slice_id, y, x) GROUP BY 1)
SELECT slice_id, round(pr, 9) AS precision, round(rc, 9) AS recall, round(2 * pr * rc / (pr + rc), 9) AS f1 FROM p JOIN q USING (slice_id)"""))
def m08(spark, d):
    r = model.label_raster(spark, d)
    out = kernels.boundary_f1(r.select("slice_id", "y", "x", F.col("region_id").alias("v")), r.select("slice_id", "y", "x", F.when(F.col("x") % 9 == 0, 0).otherwise(F.col("region_id")).alias("v")), ["slice_id"], 2)
    return out.select("slice_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("m15_connected_components", SYN.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS MATERIALIZED (SELECT slice_id, y, x, (y - min(y) OVER i) * (max(x) OVER i - min(x) OVER i + 1) + x - min(x) OVER i + 1 AS id FROM s WHERE value > 60 WINDOW i AS (PARTITION BY slice_id)),
e AS MATERIALIZED (SELECT a.slice_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.slice_id = b.slice_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND abs(a.y - b.y) <= 1),
r(slice_id, root, id) AS (SELECT slice_id, id, id FROM p UNION SELECT r.slice_id, r.root, e.b FROM r JOIN e ON e.slice_id = r.slice_id AND e.a = r.id), c AS (SELECT slice_id, id, min(root) AS component FROM r GROUP BY 1, 2)
SELECT slice_id, component::BIGINT AS component, count(*) AS area FROM c GROUP BY 1, 2""")
def m15(spark, d):
    px = model.image_stack(spark, d).where("value > 60")
    return kernels.connected_components(px, ["slice_id"]).groupBy("slice_id", "component").agg(F.count("*").alias("area"))


@query("m15_gradient", SYN + ", g AS (SELECT slice_id, y, x, lead(value) OVER r - lag(value) OVER r AS gx, lead(value) OVER c - lag(value) OVER c AS gy FROM s WINDOW r AS (PARTITION BY slice_id, y ORDER BY x), c AS (PARTITION BY slice_id, x ORDER BY y)) SELECT slice_id, y, x, round(sqrt(gx * gx + gy * gy), 6) AS g FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL")
def m15b(spark, d):
    return kernels.gradient(model.image_stack(spark, d), ["slice_id"]).withColumn("g", F.round("g", 6))


@query("m16_log_blobs")
def m16(spark, d):
    return kernels.log_blobs(model.image_stack(spark, d), ["slice_id"])


FLOW = SYN + ", f AS (SELECT slice_id, y, x, value / 10.0::DOUBLE - 5 AS v, value / 20.0::DOUBLE AS u FROM s), c AS (SELECT slice_id, y, x, v * least(1, 8 / greatest(sqrt(v * v + u * u), 1e-9)) AS v, u * least(1, 8 / greatest(sqrt(v * v + u * u), 1e-9)) AS u FROM f)"


def _flow(spark, d):
    return kernels.clip_flow(model.image_stack(spark, d).selectExpr("slice_id", "y", "x", "value / 10.0D - 5 v", "value / 20.0D u"), 8.0)


def _diffused(i: int) -> str:
    near = lambda c: f"coalesce(lag({c}) OVER r, {c}) + coalesce(lead({c}) OVER r, {c}) + coalesce(lag({c}) OVER k, {c}) + coalesce(lead({c}) OVER k, {c})"
    step = lambda c: f"{c} + 0.18::DOUBLE * ({near(c)} - 4 * {c}) AS {c}"
    return f", c{i + 1} AS (SELECT slice_id, y, x, {step('v')}, {step('u')} FROM c{i or ''} WINDOW r AS (PARTITION BY slice_id, y ORDER BY x), k AS (PARTITION BY slice_id, x ORDER BY y))"


@query("m22_flow_clip_smooth", FLOW + _diffused(0) + _diffused(1) + " SELECT slice_id, y, x, round(v, 7) AS v, round(u, 7) AS u FROM c2")
def m22(spark, d):
    f = flow.smooth_flow(_flow(spark, d), ["slice_id"], 2)
    return f.select("slice_id", "y", "x", F.round("v", 7).alias("v"), F.round("u", 7).alias("u"))


@query("m22_warp_nearest", FLOW + " SELECT c.slice_id, c.y, c.x, coalesce(s.value, 0)::INT AS region_id FROM c LEFT JOIN s ON s.slice_id = c.slice_id AND s.y = round_even(c.y + round(v, 6), 0) AND s.x = round_even(c.x + round(u, 6), 0)")
def m22b(spark, d):
    f = _flow(spark, d).withColumns({"v": F.round("v", 6), "u": F.round("u", 6)})
    return kernels.warp_nearest(model.image_stack(spark, d).withColumnRenamed("value", "region_id"), f, ["slice_id"])


def _spread(of: str, axis: str, other: str) -> str:
    """Sums of `of` under a Gaussian of sigma 6 along an axis of 64 pixels, edges mirrored."""
    return f"SELECT s.g, t.p AS {axis}, s.{other}, sum(w * v) AS v, sum(w * u) AS u, sum(w * n) AS n FROM {of} s, range(64) t(p), k WHERE s.{axis} = CASE WHEN t.p + o < 0 THEN -1 - t.p - o WHEN t.p + o > 63 THEN 127 - t.p - o ELSE t.p + o END GROUP BY ALL"


_NEAR = lambda c: f"coalesce(lag({c}) OVER r, {c}) + coalesce(lead({c}) OVER r, {c}) + coalesce(lag({c}) OVER q, {c}) + coalesce(lead({c}) OVER q, {c})"


@query("m22_splat_field", f"""WITH s AS (SELECT (l_orderkey % 32)::INT AS g, l_suppkey % 64 AS y, l_partkey % 64 AS x, sum(l_discount * 20)::DOUBLE AS v, sum(l_quantity / 10 - 2.5)::DOUBLE AS u, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT o, exp(-0.5::DOUBLE * o * o / 36) / (SELECT sum(exp(-0.5::DOUBLE * p * p / 36)) FROM range(-24, 25) z(p)) AS w FROM range(-24, 25) t(o)),
a AS MATERIALIZED ({_spread('s', 'y', 'x')}), b AS MATERIALIZED ({_spread('a', 'x', 'y')}), f AS (SELECT c.g, p.y, q.x, coalesce(v / (n + 1e-4), 0) AS v, coalesce(u / (n + 1e-4), 0) AS u FROM (SELECT DISTINCT g FROM s) c CROSS JOIN range(64) p(y) CROSS JOIN range(64) q(x) LEFT JOIN b ON b.g = c.g AND b.y = p.y AND b.x = q.x),
h AS (SELECT g, y, x, v + 0.18::DOUBLE * ({_NEAR('v')} - 4 * v) AS v, u + 0.18::DOUBLE * ({_NEAR('u')} - 4 * u) AS u FROM f WINDOW r AS (PARTITION BY g, y ORDER BY x), q AS (PARTITION BY g, x ORDER BY y))
SELECT g, y::INT AS y, x::INT AS x, round(v * least(1, 8 / (sqrt(v * v + u * u) + 1e-6)), 6) + 0.0 AS v, round(u * least(1, 8 / (sqrt(v * v + u * u) + 1e-6)), 6) + 0.0 AS u FROM h""")
def m22c(spark, d):
    m = model.table(spark, d, "lineitem").selectExpr("cast(l_orderkey % 32 as int) g", "cast(l_partkey % 64 as double) src_x", "cast(l_suppkey % 64 as double) src_y", "l_partkey % 64 + l_quantity / 10 - 2.5 dst_x", "l_suppkey % 64 + l_discount * 20 dst_y")
    return flow.splat_field(m, ["g"], (64, 64)).withColumns({c: F.round(c, 6) + 0.0 for c in ("v", "u")})


@query("m23_laplacian_field")
def m23(spark, d):
    n = model.slices(spark, d, 1000, 4)
    b = spark.range(10 * n).selectExpr(f"cast(id % {n} as int) z", "cast(id * 7 % 16 as int) y", "cast(id * 5 % 16 as int) x", "cast(id % 5 as double) value").groupBy("z", "y", "x").agg(F.max("value").alias("value"))
    return kernels.laplace_field(b, ["z"], (16, 16))


@query("m24_normals", PAIRS + ", q AS (SELECT pair, (i % 8)::DOUBLE AS x, (i // 8)::DOUBLE + a AS y FROM p), s AS (SELECT pair, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM q GROUP BY 1) SELECT pair, round(abs(sin(0.5 * atan2(2 * c, a - b))), 6) AS nx, round(abs(cos(0.5 * atan2(2 * c, a - b))), 6) AS ny FROM s")
def m24(spark, d):
    q = _pairs(spark, d).selectExpr("pair", "cast(x as double) x", "y + a y")
    return kernels.normals(q, ["pair"]).select("pair", F.round(F.abs("nx"), 6).alias("nx"), F.round(F.abs("ny"), 6).alias("ny"))


@query("g28_unique_correspondences", "SELECT l_orderkey % 50 AS fy, l_partkey % 50 AS fx, round_even(avg(l_suppkey % 40), 0)::INT AS my, count(*) AS n FROM lineitem GROUP BY 1, 2")
def g28(spark, d):
    p = model.table(spark, d, "lineitem").selectExpr("l_orderkey % 50 fy", "l_partkey % 50 fx", "l_suppkey % 40 my")
    return placement.unique_correspondences(p, ["fy", "fx"], ["my"])


@query("m12_candidate_objective", """WITH c AS (SELECT s_suppkey AS k, s_suppkey % 100 / 100.0::DOUBLE AS q, s_suppkey % 71 / 70.0::DOUBLE AS cov, s_suppkey % 37 / 36.0::DOUBLE AS l, s_suppkey % 29 / 28.0::DOUBLE AS r FROM supplier)
SELECT k, round(q + 0.34 * cov + 0.30 * least(l, r) - 1.08 * greatest(0, abs(l - r) - 0.14) - 2.15 * greatest(0, 0.93 - cov) - 1.30 * greatest(0, 0.78 - least(l, r)), 9) AS objective FROM c""")
def m12(spark, d):
    c = model.table(spark, d, "supplier").selectExpr("s_suppkey k", "s_suppkey % 100 / 100.0D q", "s_suppkey % 71 / 70.0D cov", "s_suppkey % 37 / 36.0D l", "s_suppkey % 29 / 28.0D r")
    return c.select("k", F.round(selection.objective(F.col("q"), F.col("cov"), F.col("l"), F.col("r")), 9).alias("objective"))


@query("m27_hemisphere_candidates", """WITH c AS (SELECT s_suppkey // 5 AS slice, s_suppkey % 5 AS o, s_suppkey * 37 % 100 / 100.0::DOUBLE AS s0, s_suppkey * 53 % 100 / 100.0::DOUBLE AS s1 FROM supplier), k AS (SELECT slice, o, CASE WHEN s1 >= s0 - 0.003 THEN s1 ELSE s0 END AS f, s1 >= s0 - 0.003 AS opt FROM c)
SELECT slice, arg_max(o, {'f': f, 'o': -o})::INT AS candidate, max(f) AS objective FROM k GROUP BY 1""")
def m27(spark, d):
    c = model.table(spark, d, "supplier").selectExpr("s_suppkey div 5 slice", "cast(s_suppkey % 5 as int) ord", "s_suppkey * 37 % 100 / 100.0D initial", "s_suppkey * 53 % 100 / 100.0D optimised")
    return selection.best_candidate(c, ["slice"])


@query("m39_nonlinear_selection", """WITH c AS (SELECT s_suppkey AS slice, s_suppkey * 37 % 1000 / 1000.0::DOUBLE AS b, s_suppkey * 53 % 1000 / 1000.0::DOUBLE AS f, s_suppkey * 71 % 1000 / 1000.0::DOUBLE AS l, s_suppkey * 91 % 1000 / 1000.0::DOUBLE AS a FROM supplier), m AS (SELECT *, greatest(b, f, l, a) AS m FROM c)
SELECT slice, CASE WHEN l >= m - 0.003 AND l >= b + 0.006 THEN 'liquify' WHEN a >= m - 0.0025 AND a >= b + 0.004 THEN 'ants' WHEN m < b - 0.006 OR b = m THEN 'baseline' WHEN f = m THEN 'flow' WHEN l = m THEN 'liquify' ELSE 'ants' END AS method FROM m""")
def m39(spark, d):
    c = model.table(spark, d, "supplier").selectExpr("s_suppkey slice", *[f"s_suppkey * {k} % 1000 / 1000.0D {n}" for n, k in (("baseline", 37), ("flow", 53), ("liquify", 71), ("ants", 91))])
    return c.select("slice", selection.nonlinear(F.col("baseline"), F.col("flow"), F.col("liquify"), F.col("ants")).alias("method"))


@query("m38_placement_scale", "SELECT s_suppkey AS k, round(least(1.5, greatest(0.5, sqrt(abs(s_acctbal) / 4000.0::DOUBLE))), 9) AS scale FROM supplier")
def m38(spark, d):
    return model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round(selection.placement_scale(F.abs("s_acctbal"), F.lit(4000.0)), 9).alias("scale"))


@query("m37_contour_match", PAIRS + """, q AS (SELECT pair, i, CASE WHEN i % 2 = 0 THEN atan2(a, b) END AS ta, CASE WHEN i % 2 = 1 THEN atan2(a, b) END AS tb FROM p), k AS (SELECT pair, k, 2 * pi() * k / 12 - pi() AS t, i, ta, tb FROM q, range(12) r(k))
SELECT pair, k::INT AS k, arg_min(i, {'d': round(abs(ta - t - 2 * pi() * round((ta - t) / (2 * pi()))), 9), 'i': i}) FILTER (ta IS NOT NULL)::INT AS a, arg_min(i, {'d': round(abs(tb - t - 2 * pi() * round((tb - t) / (2 * pi()))), 9), 'i': i}) FILTER (tb IS NOT NULL)::INT AS b FROM k GROUP BY 1, 2""")
def m37(spark, d):
    q = _pairs(spark, d).select("pair", F.col("i").alias("ord"), F.atan2("a", "b").alias("angle"), F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("side"))
    return selection.match_by_angle(q, ["pair"], 12)


@query("r10_end_to_end", with_sql("structure", "cells", body=MAPPED + " SELECT count(*) AS cells, count(*) FILTER (mapping_status = 'ok') AS mapped, count(DISTINCT region_id) AS regions, count(DISTINCT slice_id) AS slices FROM mapped"))
def r10(spark, d):
    m = core._mapped(spark, d)  # noqa: SLF001
    return m.agg(F.count("*").alias("cells"), F.count_if(F.col("mapping_status") == "ok").alias("mapped"), F.countDistinct("region_id").alias("regions"), F.countDistinct("slice_id").alias("slices"))


@query("f12_keep_columns", with_sql("cells", body=" SELECT cell_id, slice_id, area_px FROM cells"))
def f12(spark, d):
    return mapping.keep_columns(model.cells(spark, d), ["cell_id", "slice_id"], ["area_px", "solidity"])


@query("r14_sample_manifest", with_sql("cells", body=", s AS (SELECT slice_id, row_number() OVER (ORDER BY slice_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT slice_id FROM cells)), k AS (SELECT slice_id FROM s WHERE i IN (SELECT floor(k * (n - 1) / 2)::BIGINT FROM range(3) t(k))) SELECT slice_id, count(*) AS count, array_to_string(list_sort(list_distinct(list(detector))), ', ') AS detectors FROM cells JOIN k USING (slice_id) GROUP BY 1"))
def r14(spark, d):
    from ..operators import summary

    return summary.even_sample(summary.file_samples(model.cells(spark, d)), "slice_id", 3)
