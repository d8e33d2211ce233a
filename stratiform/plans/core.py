"""Queries on cells: mapping, roll-up, series, suppression, summaries; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import text
from ..model import with_sql
from ..operators import compare, control, dedup, mapping, rollup, series, summary

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _mapped(spark, d):
    return mapping.attach_structure(model.cells(spark, d), model.structure(spark, d)).withColumn("mapping_status", F.when(F.col("region_id") == 0, "outside_atlas").otherwise("ok"))


MAPPED = """,
mapped AS (SELECT c.*, coalesce(s.name, CASE WHEN c.region_id = 0 THEN 'OUTSIDE_ATLAS' ELSE 'UNKNOWN_REGION_' || c.region_id END) AS region_name,
  coalesce(s.acronym, CASE WHEN c.region_id = 0 THEN 'OUT' ELSE 'RID_' || c.region_id END) AS acronym, coalesce(p.name, '') AS parent_name,
  CASE s.hemisphere_id WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'bilateral' ELSE 'unknown' END AS hemisphere,
  s.parent_structure_id, s.structure_id_path, s.depth, s.graph_order, CASE WHEN c.region_id = 0 THEN 'outside_atlas' ELSE 'ok' END AS mapping_status
  FROM cells c LEFT JOIN structure s ON c.region_id = s.id LEFT JOIN structure p ON s.parent_structure_id = p.id)"""
LOW = "CASE WHEN n <= 0 THEN 0.0 ELSE round_even(greatest(0.0::DOUBLE, n * pow(1 - 1 / (9 * n) - 1.96::DOUBLE / (3 * sqrt(n)), 3)), 1) END"
HIGH = "round_even((n + 1) * pow(1 - 1 / (9 * (n + 1)) + 1.96::DOUBLE / (3 * sqrt(n + 1)), 3), 1)"
HIER = MAPPED + f""",
up AS (SELECT unnest(list_filter(list_transform(string_split(trim(structure_id_path, '/'), '/'), lambda p: try_cast(p AS INT)), lambda p: p IS NOT NULL)) AS region_id, hemisphere, c FROM (SELECT structure_id_path, hemisphere, count(*) AS c FROM mapped WHERE structure_id_path IS NOT NULL GROUP BY 1, 2)),
hc AS (SELECT region_id, hemisphere, sum(c)::BIGINT AS count, sum(c)::DOUBLE AS n FROM up GROUP BY 1, 2),
hierarchy AS (SELECT hc.region_id, hemisphere, count, name AS region_name, acronym, parent_structure_id, depth, graph_order, n / (SELECT count(*) FROM mapped) AS confidence, {LOW} AS ci_low, {HIGH} AS ci_high FROM hc LEFT JOIN structure ON hc.region_id = structure.id)"""


@query("g05_ontology_rollup", with_sql("structure", "cells", body=HIER + " SELECT * REPLACE (coalesce(parent_structure_id, -1) AS parent_structure_id) FROM hierarchy"))
def g05(spark, d):
    return rollup.hierarchy_counts(_mapped(spark, d), model.structure(spark, d)).withColumn("parent_structure_id", F.coalesce("parent_structure_id", F.lit(-1)))


@query("g01_leaf_counts", with_sql("structure", "cells", body=MAPPED + f""",
g AS (SELECT region_id, region_name, acronym, hemisphere, count(*) AS count, count(*)::DOUBLE AS n, round(avg(area_px), 3) AS mean_area_px, round(avg(elongation), 6) AS mean_elongation, round(avg(mean_intensity), 6) AS mean_mean_intensity, coalesce(any_value(parent_structure_id), -1) AS parent_structure_id, coalesce(any_value(depth), -1) AS depth, coalesce(any_value(graph_order), -1) AS graph_order FROM mapped GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (n), n / (SELECT count(*) FROM mapped) AS confidence, {LOW} AS ci_low, {HIGH} AS ci_high FROM g"""))
def g01(spark, d):
    out = rollup.leaf_counts(_mapped(spark, d))
    return out.withColumns({"mean_area_px": F.round("mean_area_px", 3), "mean_elongation": F.round("mean_elongation", 6), "mean_mean_intensity": F.round("mean_mean_intensity", 6), **{c: F.coalesce(c, F.lit(-1)) for c in ("parent_structure_id", "depth", "graph_order")}})


@query("j02_attach_structure", with_sql("structure", "cells", body=MAPPED + " SELECT region_id, region_name, acronym, parent_name, hemisphere, mapping_status, count(*) AS n FROM mapped GROUP BY ALL"))
def j02(spark, d):
    return _mapped(spark, d).groupBy("region_id", "region_name", "acronym", "parent_name", "hemisphere", "mapping_status").agg(F.count("*").alias("n"))


@query("j01_slice_map", with_sql("cells", body=""", sm AS (SELECT i::INT AS slice_id, (10000 + i)::INT AS region_id, 'slice ' || i AS region_name, 'left' AS hemisphere FROM range(0, 64, 2) t(i))
SELECT coalesce(sm.region_id, 0)::INT AS region_id, coalesce(region_name, 'OUTSIDE') AS region_name, 'OUT' AS acronym, coalesce(hemisphere, 'unknown') AS hemisphere, count(*) AS n FROM cells LEFT JOIN sm USING (slice_id) GROUP BY ALL"""))
def j01(spark, d):
    sm = spark.range(0, 64, 2).selectExpr("cast(id as int) slice_id", "cast(10000 + id as int) region_id", "concat('slice ', id) region_name", "'left' hemisphere", "cast(null as string) acronym")
    return mapping.map_by_slice(model.cells(spark, d).drop("region_id"), sm).groupBy("region_id", "region_name", "acronym", "hemisphere").agg(F.count("*").alias("n"))


@query("j04_raster_lookup", with_sql("points", "label_raster", body=""", p AS (SELECT *, round_even(x * 1.3::DOUBLE - 40, 0)::INT AS px, round_even(y * 5.1::DOUBLE, 0)::INT AS py FROM (SELECT * REPLACE (slice_id % 4 AS slice_id) FROM points)),
j AS (SELECT p.cell_id, px, py, CASE WHEN px BETWEEN 0 AND 511 AND py BETWEEN 0 AND 511 THEN CASE WHEN l.region_id = 997 THEN 0 ELSE coalesce(l.region_id, 0) END ELSE 0 END AS region_id FROM p LEFT JOIN label_raster l ON p.slice_id = l.slice_id AND px = l.x AND py = l.y)
SELECT cell_id, region_id, CASE WHEN NOT (px BETWEEN 0 AND 511 AND py BETWEEN 0 AND 511) THEN 'outside_slice_bounds' WHEN region_id > 0 THEN 'ok' ELSE 'outside_registered_slice' END AS mapping_status FROM j"""))
def j04(spark, d):
    p = model.points(spark, d).withColumns({"slice_id": F.col("slice_id") % 4, "x": F.col("x") * 1.3 - 40, "y": F.col("y") * 5.1})
    return mapping.look_up_slice(p, model.label_raster(spark, d), model.HEIGHT, model.WIDTH).select("cell_id", "region_id", "mapping_status")


@query("j05_voxel_lookup", with_sql("points", "label_raster", body=""", p AS (SELECT cell_id, round_even(slice_id % 6 * 25.0::DOUBLE / 25.0, 0)::INT AS vz, round_even(y * 50.0::DOUBLE / 25.0, 0)::INT AS vy, round_even(x * 50.0::DOUBLE / 25.0, 0)::INT AS vx FROM points),
i AS (SELECT *, vz BETWEEN 0 AND 3 AND vy BETWEEN 0 AND 511 AND vx BETWEEN 0 AND 511 AS inside FROM p),
j AS (SELECT i.cell_id, inside, CASE WHEN inside AND l.region_id <> 997 THEN coalesce(l.region_id, 0) ELSE 0 END AS region_id FROM i LEFT JOIN label_raster l ON vz = l.slice_id AND vy = l.y AND vx = l.x)
SELECT cell_id, region_id, CASE WHEN NOT inside THEN 'outside_volume' WHEN region_id > 0 THEN 'ok' ELSE 'outside_atlas' END AS mapping_status FROM j"""))
def j05(spark, d):
    vol = model.label_raster(spark, d).withColumnRenamed("slice_id", "z")
    p = model.points(spark, d).withColumn("slice_id", F.col("slice_id") % 6)
    return mapping.look_up_volume(p, vol, (4, model.HEIGHT, model.WIDTH), 50.0, 25.0).select("cell_id", "region_id", "mapping_status")


@query("j06_region_at", with_sql("structure", "label_raster", body=""" SELECT slice_id, y, x, (CASE WHEN l.region_id = 997 THEN 0 ELSE l.region_id END)::INT AS region_id, s.name AS region_name, s.acronym, coalesce(p.name, '') AS parent_name FROM label_raster l LEFT JOIN structure s ON s.id = l.region_id LEFT JOIN structure p ON p.id = s.parent_structure_id WHERE slice_id = 1 AND x = 240 AND y = 250"""))
def j06(spark, d):
    return mapping.region_at(model.label_raster(spark, d), model.structure(spark, d), 1, 240, 250).select("slice_id", "y", "x", "region_id", "region_name", "acronym", "parent_name")


@query("f01_um_columns", with_sql("points", body=" SELECT cell_id, x * 0.65::DOUBLE AS x_um, y * 0.65::DOUBLE AS y_um, slice_id * 25.0::DOUBLE AS z_um FROM points"))
def f01(spark, d):
    return mapping.um_columns(model.points(spark, d), 0.65, 25.0).select("cell_id", "x_um", "y_um", "z_um")


@query("j07_radius_join", with_sql("points", body=" SELECT a.cell_id AS a, b.cell_id AS b FROM points a JOIN points b ON a.slice_id = b.slice_id AND a.cell_id < b.cell_id AND ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 36.0::DOUBLE <= 1.0"))
def j07(spark, d):
    return dedup.near_pairs(model.points(spark, d), r_xy=6.0, group=["slice_id"]).select("a", "b")


@query("j08_radius_join_3d", with_sql("points", body=" SELECT a.cell_id AS a, b.cell_id AS b FROM points a JOIN points b ON a.cell_id < b.cell_id AND abs(a.slice_id - b.slice_id) <= 1 AND ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 16.0::DOUBLE + ((a.slice_id - b.slice_id) * 10.0::DOUBLE / 12.5) * ((a.slice_id - b.slice_id) * 10.0::DOUBLE / 12.5) <= 1.0"))
def j08(spark, d):
    p = model.points(spark, d).withColumns({"z": F.col("slice_id") * 10.0, "block": F.lit(0)})
    return dedup.near_pairs(p, r_xy=4.0, group=["block"], r_z=12.5, neighbor_slices=1).select("a", "b")


#: Greedy suppression by score in SQL: each group's cells in turn, with the list of those kept so far.
GREEDY = """,
n AS (SELECT b.cell_id AS id, list(a.cell_id) AS near FROM points a JOIN points b ON a.slice_id = b.slice_id AND a.cell_id <> b.cell_id AND ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 36.0::DOUBLE <= 1.0 GROUP BY 1),
o AS (SELECT p.cell_id, p.slice_id, row_number() OVER (PARTITION BY p.slice_id ORDER BY coalesce(p.score, 0.0) DESC, p.cell_id) AS k, coalesce(n.near, []::BIGINT[]) AS near FROM points p LEFT JOIN n ON n.id = p.cell_id),
g(slice_id, k, kept) AS (SELECT DISTINCT slice_id, 0::BIGINT, []::BIGINT[] FROM o UNION ALL SELECT g.slice_id, o.k, CASE WHEN list_has_any(g.kept, o.near) THEN g.kept ELSE list_append(g.kept, o.cell_id) END FROM g JOIN o ON o.slice_id = g.slice_id AND o.k = g.k + 1),
l AS (SELECT slice_id, unnest(arg_max(kept, k)) AS cell_id FROM g GROUP BY 1)"""


def greedy(body: str) -> str:
    return with_sql("points", body=GREEDY + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("w06_greedy_suppression", greedy(" SELECT p.cell_id, l.cell_id IS NOT NULL AS kept FROM points p LEFT JOIN l USING (cell_id)"))
def w06(spark, d):
    p = model.points(spark, d)
    return dedup.thin(p, r_xy=6.0, group=["slice_id"]).select("cell_id", "kept")


@query("g09_dedup_stats", greedy(", c AS (SELECT (SELECT count(*) FROM points) AS before, (SELECT count(*) FROM l) AS after) SELECT before, after, before - after AS merged, round_even((before - after) / before, 6) AS ratio FROM c"))
def g09(spark, d):
    p = model.points(spark, d)
    return dedup.stats(dedup.thin(p, r_xy=6.0, group=["slice_id"]))


SMOOTH = """,
good AS (SELECT series, slice_id, best_z, count(*) OVER (PARTITION BY series) AS n FROM slice_qc WHERE registration_ok),
fit AS (SELECT series, slice_id, CASE WHEN n >= 5 THEN median(best_z::DOUBLE) OVER (PARTITION BY series ORDER BY slice_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) WHEN n = 4 THEN median(best_z::DOUBLE) OVER (PARTITION BY series ORDER BY slice_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)
  WHEN n = 3 THEN median(best_z::DOUBLE) OVER (PARTITION BY series ORDER BY slice_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) WHEN n = 2 THEN best_z::DOUBLE END AS raw FROM good),
fitc AS (SELECT *, greatest(0, least(527, round_even(raw, 0)))::INT AS v FROM fit WHERE raw IS NOT NULL),
near AS (SELECT q.series, q.slice_id, arg_min(f.v, {'a': abs(f.slice_id - q.slice_id), 'b': f.slice_id}) AS v FROM slice_qc q JOIN fitc f USING (series) WHERE NOT q.registration_ok GROUP BY 1, 2),
smoothed AS (SELECT q.series, q.slice_id, q.best_z AS original_z, coalesce(f.v, near.v, q.best_z) AS smoothed_z, round_even(coalesce(abs(q.best_z - f.raw), abs(q.best_z - near.v), 0)::DOUBLE, 2) AS deviation, f.raw IS NOT NULL AND coalesce(abs(q.best_z - f.raw), 0) > 8 AS is_outlier, f.raw IS NOT NULL AS fitted
  FROM slice_qc q LEFT JOIN fitc f ON q.series = f.series AND q.slice_id = f.slice_id LEFT JOIN near ON q.series = near.series AND q.slice_id = near.slice_id)"""


@query("w02_z_continuity", with_sql("slice_qc", body=SMOOTH + " SELECT * FROM smoothed"))
def w02(spark, d):
    return series.smooth(model.slice_qc(spark, d))


@query("g22_continuity_report", with_sql("slice_qc", body=SMOOTH + """, s AS (SELECT *, coalesce(smoothed_z >= lag(smoothed_z) OVER (PARTITION BY series ORDER BY slice_id), true) AS up FROM smoothed)
SELECT series, count(*) AS n_slices, count(*) FILTER (is_outlier) AS outlier_count, coalesce(max(deviation) FILTER (fitted), 0)::DOUBLE AS max_deviation, coalesce(round_even(avg(deviation) FILTER (fitted), 2), 0)::DOUBLE AS mean_deviation, bool_and(up) AS monotone FROM s GROUP BY 1"""))
def g22(spark, d):
    return series.report(series.smooth(model.slice_qc(spark, d)))


@query("g21_score_stats", with_sql("slice_qc", body=" SELECT count(*) AS n, count(*) FILTER (registration_ok) AS ok, count(*) FILTER (best_score >= 0.65) AS passing, round_even(avg(best_score), 3) AS mean, round_even(min(best_score), 3) AS min, round_even(max(best_score), 3) AS max FROM slice_qc"))
def g21(spark, d):
    from ..operators.registration import score_stats

    return score_stats(model.slice_qc(spark, d))


@query("g07_slice_qc", with_sql("cells", body=" SELECT slice_id, count(*) AS cell_count, 'ok' AS status FROM cells GROUP BY 1"))
def g07(spark, d):
    return summary.slice_qc(model.cells(spark, d))


@query("g10_detector_counts", with_sql("cells", body=" SELECT coalesce(detector, 'unknown') AS detector, count(*) AS count FROM cells GROUP BY 1"))
def g10(spark, d):
    return summary.detector_counts(model.cells(spark, d))


TEST_GROUPS = [("First", 1000), ("Second", 1001), ("Third", 2007), ("Fourth", 1003)]


@query("g13_analysis_groups", with_sql("structure", "cells", body=MAPPED + """, l AS (SELECT CASE WHEN mapping_status <> 'ok' THEN 'Outside Atlas' WHEN ids @> [1000] THEN 'First' WHEN ids @> [1001] THEN 'Second' WHEN ids @> [2007] THEN 'Third' WHEN ids @> [1003] THEN 'Fourth' ELSE 'Other Mapped' END AS label
FROM (SELECT mapping_status, list_append(list_transform(regexp_extract_all(coalesce(structure_id_path, ''), '\\d+'), lambda x: x::INT), region_id) AS ids FROM mapped)) SELECT label, count(*) AS count FROM l GROUP BY 1"""))
def g13(spark, d):
    return summary.analysis_groups(_mapped(spark, d), TEST_GROUPS)


DISPLAY = "CASE WHEN parent_name <> '' AND parent_name NOT IN ('root') AND parent_name <> region_name THEN parent_name ELSE region_name END"


@query("g14_top_regions", with_sql("structure", "cells", body=MAPPED + f" SELECT {DISPLAY} AS region, count(*) AS count FROM mapped WHERE mapping_status = 'ok' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 14"))
def g14(spark, d):
    return summary.top_regions(_mapped(spark, d))


@query("g16_cell_summary", with_sql("structure", "cells", body=MAPPED + f""", t AS (SELECT count(*) AS total, count(*) FILTER (mapping_status = 'ok') AS mapped, count(DISTINCT slice_id) AS slices FROM mapped),
top AS (SELECT {DISPLAY} AS region, count(*) AS c FROM mapped WHERE mapping_status = 'ok' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT total, mapped, slices, total - mapped AS outside, round_even(100.0::DOUBLE * ((total - mapped)::DOUBLE / total), 2) AS outside_pct, CASE WHEN (total - mapped) / total >= 0.05 THEN printf('%.1f%% of cells are outside the atlas', 100.0::DOUBLE * ((total - mapped)::DOUBLE / total)) ELSE '' END AS warning, region AS top_region, c AS top_count,
  (SELECT array_to_string(list_sort(list_distinct(list(detector))), ', ') FROM mapped) AS detectors FROM t, top"""))
def g16(spark, d):
    return summary.cell_summary(_mapped(spark, d))


@query("g15_hierarchy_summary", with_sql("structure", "cells", body=HIER + """, r AS (SELECT max(count) FILTER (depth = 0) AS root FROM hierarchy)
SELECT region_name, max(count) AS count, root, round_even(100::DOUBLE * max(count) / root, 2) AS pct FROM hierarchy, r WHERE count > 0 AND depth BETWEEN 1 AND 2 AND NOT contains(lower(region_name), 'layer') GROUP BY region_name, root"""))
def g15(spark, d):
    return summary.hierarchy_summary(rollup.hierarchy_counts(_mapped(spark, d), model.structure(spark, d)), (1, 2))


@query("g30_depth_chart", with_sql("structure", "cells", body=HIER + ", l AS (SELECT region_id, region_name, sum(count)::BIGINT AS count FROM hierarchy WHERE depth = 2 AND count > 0 GROUP BY 1, 2) SELECT region_id, region_name, count, round_even(100::DOUBLE * count / (SELECT sum(count)::BIGINT FROM l), 4) AS pct FROM l"))
def g30(spark, d):
    return summary.depth_chart(rollup.hierarchy_counts(_mapped(spark, d), model.structure(spark, d)))


@query("g31_results_table", with_sql("structure", "cells", body=HIER + " SELECT region_id, hemisphere, region_name, count, printf('%.1f%%', 100::DOUBLE * count / (SELECT max(count) FROM hierarchy WHERE depth = 0)) AS pct FROM hierarchy WHERE contains(lower(region_name), '00') OR contains(lower(acronym), '00')"))
def g31(spark, d):
    return summary.results_table(rollup.hierarchy_counts(_mapped(spark, d), model.structure(spark, d)), "00")


@query("g20_file_samples", with_sql("cells", body=" SELECT slice_id, count(*) AS count, coalesce(array_to_string(list_sort(list_distinct(list(detector))), ', '), '') AS detectors FROM cells GROUP BY 1"))
def g20(spark, d):
    return summary.file_samples(model.cells(spark, d))


@query("g17_source_summary", with_sql("cells", body=", f AS (SELECT 'folder' || (slice_id % 5) AS folder, slice_id FROM cells) SELECT (SELECT folder FROM f GROUP BY 1 ORDER BY count(*) DESC, folder LIMIT 1) AS folder, count(DISTINCT slice_id) AS slices, min(slice_id * 2)::INT AS min_z, max(slice_id * 2)::INT AS max_z FROM f"))
def g17(spark, d):
    path = F.concat(F.lit("/data/folder"), F.col("slice_id") % 5, F.lit("/img_Z"), F.format_string("%04d", F.col("slice_id") * 2), F.lit(".tif"))
    c = model.cells(spark, d).withColumn("path", path)
    return summary.source_summary(c.withColumns({"folder": text.base_name(text.parent_dir(F.col("path"))), "z": text.z_number(text.stem(F.col("path")))}))


@query("g19_mode", with_sql("cells", body=", c AS (SELECT channel, slice_id, count(*) AS n FROM cells GROUP BY 1, 2) SELECT channel, min(slice_id) AS mode FROM c WHERE n = (SELECT max(n) FROM c c2 WHERE c2.channel = c.channel) GROUP BY 1"))
def g19(spark, d):
    return model.cells(spark, d).groupBy("channel").agg(F.mode("slice_id", True).alias("mode"))


@query("w08_even_sample", with_sql("cells", body=", s AS (SELECT slice_id, row_number() OVER (ORDER BY slice_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT slice_id FROM cells)) SELECT slice_id FROM s WHERE i IN (SELECT floor(k * (n - 1) / 6)::BIGINT FROM range(7) t(k))"))
def w08(spark, d):
    return summary.even_sample(model.cells(spark, d).select("slice_id").distinct(), "slice_id", 7)


@query("w05_top_k_distinct", with_sql("structure", "cells", body=MAPPED + ", g AS (SELECT region_id, upper(acronym) AS acr, count(*) AS area FROM mapped WHERE mapping_status = 'ok' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY substr(acr, 1, 2) ORDER BY area DESC, region_id) AS k FROM g) SELECT region_id, acr, area FROM r WHERE k = 1 ORDER BY area DESC, region_id LIMIT 6"))
def w05(spark, d):
    g = _mapped(spark, d).where("mapping_status = 'ok'").groupBy("region_id", F.upper("acronym").alias("acr")).agg(F.count("*").alias("area"))
    return summary.first_per_key(g, F.substring("acr", 1, 2), [F.desc("area"), F.asc("region_id")], 6)


@query("g11_ap_density", with_sql("cells", "slice_qc", body=", q AS (SELECT slice_id, min(best_z) AS best_z FROM slice_qc GROUP BY 1) SELECT slice_id, count(*) AS count, best_z FROM cells JOIN q USING (slice_id) GROUP BY slice_id, best_z"))
def g11(spark, d):
    return compare.ap_density(model.cells(spark, d), model.slice_qc(spark, d))


CHANNELS = MAPPED + ", red AS (SELECT acronym, count(*) AS count FROM mapped WHERE channel = 'O' GROUP BY 1), green AS (SELECT acronym, count(*) AS count FROM mapped WHERE channel = 'F' GROUP BY 1)"


@query("j12_coexpression", with_sql("structure", "cells", body=CHANNELS + " SELECT acronym, coalesce(red.count, 0) AS red, coalesce(green.count, 0) AS green, least(coalesce(red.count, 0), coalesce(green.count, 0)) AS both, round_even(coalesce(red.count, 0)::DOUBLE / greatest(coalesce(red.count, 0) + coalesce(green.count, 0), 1), 6) AS ratio FROM red FULL JOIN green USING (acronym)"))
def j12(spark, d):
    m = _mapped(spark, d)
    red = m.where("channel = 'O'").groupBy("acronym").agg(F.count("*").alias("count"))
    green = m.where("channel = 'F'").groupBy("acronym").agg(F.count("*").alias("count"))
    return compare.coexpression(red, green, "acronym")


@query("g12_channel_totals", with_sql("cells", body=" SELECT channel, count(*) AS total FROM cells GROUP BY 1"))
def g12(spark, d):
    return compare.channel_totals(model.cells(spark, d).groupBy("channel", "region_id").agg(F.count("*").alias("count")))


@query("j13_compare_samples", with_sql("structure", "cells", body=MAPPED + """, t AS (SELECT sample, count(*) AS t FROM mapped GROUP BY 1), g AS (SELECT sample, region_id, hemisphere, region_name, acronym, depth, count(*) AS c, count(*)::DOUBLE / t AS f FROM mapped JOIN t USING (sample) GROUP BY sample, region_id, hemisphere, region_name, acronym, depth, t)
SELECT region_id, hemisphere, region_name, acronym, coalesce(depth, -1) AS depth, coalesce(max(c) FILTER (sample = 'A'), 0) AS count_A, coalesce(max(c) FILTER (sample = 'N'), 0) AS count_N, coalesce(max(c) FILTER (sample = 'R'), 0) AS count_R,
  round_even(coalesce(max(f) FILTER (sample = 'A'), 0)::DOUBLE, 6) AS confidence_A, round_even(coalesce(max(f) FILTER (sample = 'N'), 0)::DOUBLE, 6) AS confidence_N, round_even(coalesce(max(f) FILTER (sample = 'R'), 0)::DOUBLE, 6) AS confidence_R FROM g GROUP BY 1, 2, 3, 4, 5"""))
def j13(spark, d):
    m = _mapped(spark, d)
    total = m.groupBy("sample").agg(F.count("*").alias("t"))
    g = m.groupBy(F.col("sample").alias("label"), "region_id", "hemisphere", "region_name", "acronym", "depth").agg(F.count("*").alias("count"))
    g = g.join(total, g["label"] == total["sample"]).withColumn("confidence", F.col("count") / F.col("t"))
    return compare.compare_samples(g, ["A", "N", "R"]).withColumn("depth", F.coalesce("depth", F.lit(-1)))


@query("f02_f18_label_predicates", with_sql("structure", body=", p AS (SELECT s.id, s.name, s.acronym, coalesce(q.name, '') AS pn FROM structure s LEFT JOIN structure q ON s.parent_structure_id = q.id) SELECT id, CASE WHEN pn <> '' AND pn <> 'root' AND pn <> name THEN pn ELSE name END AS display, name <> 'root' AS meaningful FROM p"))
def f18(spark, d):
    s = model.structure(spark, d)
    p = s.select(F.col("id").alias("pid"), F.col("name").alias("pn"))
    j = s.join(p, s["parent_structure_id"] == p["pid"], "left")
    return j.select("id", summary.display_region(F.col("name"), F.col("pn")).alias("display"), summary.meaningful(F.col("acronym"), F.col("name")).alias("meaningful"))


@query("w12_tail", with_sql("run_events", body=" SELECT sample_id, id, event FROM run_events QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY id DESC) <= 20"))
def w12(spark, d):
    return control.tail(model.run_events(spark, d), 20).select("sample_id", "id", "event")


@query("r05_sample_state", with_sql("run_events", body=", l AS (SELECT sample_id, arg_max(event, id) AS e, arg_max(timestamp, id) AS t, count(*) AS n_events FROM run_events GROUP BY 1) SELECT sample_id, CASE WHEN e = 'cancel' THEN 'pending' ELSE e END AS status, CASE WHEN e IN ('done', 'error') THEN t END AS finished_at, n_events FROM l"))
def r05(spark, d):
    return control.sample_state(model.run_events(spark, d))


@query("r05_state_durations", with_sql("run_events", body=", e AS (SELECT event, timestamp AS t, lead(timestamp) OVER (PARTITION BY sample_id ORDER BY id) AS n FROM run_events) SELECT event, count(n) AS n, sum(floor(epoch(n)) - floor(epoch(t)))::BIGINT AS seconds FROM e GROUP BY 1"))
def r05b(spark, d):
    return control.state_durations(model.run_events(spark, d))


@query("s17_recent_events", with_sql("run_events", body=" SELECT id, sample_id, event FROM run_events WHERE sample_id = 's3' ORDER BY id DESC LIMIT 50"))
def s17(spark, d):
    return control.recent(model.run_events(spark, d), "s3", 50).select("id", "sample_id", "event")


@query("j19_delete_project", with_sql("run_events", body=" SELECT sample_id, count(*) AS n FROM run_events WHERE sample_id NOT IN (SELECT sample_id FROM run_events WHERE project_id = 'p3') GROUP BY 1"))
def j19(spark, d):
    e = model.run_events(spark, d)
    return control.delete_project(e, e.select("sample_id", "project_id").distinct(), "p3").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("s20_next_free_id", " SELECT min(c)::BIGINT AS next_id FROM (SELECT 1 AS c UNION SELECT event_id + 1 FROM events) WHERE c NOT IN (SELECT event_id FROM events)")
def s20(spark, d):
    return control.next_free_id(model.table(spark, d, "events").select(F.col("event_id").alias("id")))
