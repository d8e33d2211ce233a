"""Small cases with known answers, edge cases and brute-force comparisons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.functions import text
from stratiform.operators import control, dedup, kernels, mapping, raster, rollup, series, validate
from stratiform.sources import files
from stratiform.streaming import progress


def test_poisson_interval(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (100.0,)], "n double").select(rollup.poisson_low(F.col("n")), rollup.poisson_high(F.col("n"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 4.8, 81.4]
    assert [r[1] for r in rows][1:] == [5.6, 18.4, 121.6]


def test_rollup_counts_each_ancestor(spark):
    st = spark.createDataFrame([(997, "root", "root", None, "/997/", 0, 1, 3), (8, "grey", "G", 997, "/997/8/", 1, 2, 1)], "id int, name string, acronym string, parent_structure_id int, structure_id_path string, depth int, graph_order int, hemisphere_id int")
    cells = spark.createDataFrame([(1, 8), (2, 8), (3, 0)], "cell_id long, region_id int")
    leaf, up = rollup.aggregate_by_region(mapping.attach_structure(cells, st), st)
    assert {(r.region_id, r["count"]) for r in up.collect()} == {(997, 2), (8, 2)}
    assert {(r.region_name, r["count"]) for r in leaf.collect()} == {("grey", 2), ("OUTSIDE_ATLAS", 1)}
    assert abs(sum(r.confidence for r in leaf.collect()) - 1) < 1e-9
    empty, none = rollup.aggregate_by_region(mapping.attach_structure(cells.where("false"), st), st)
    assert empty.count() == none.count() == 0


def test_mapping_statuses(spark):
    px = [(0, y, x, 997 if (y, x) in ((4, 4), (11, 11)) else 5) for y in range(20) for x in range(20)]
    lab = spark.createDataFrame(px, "slice_id int, y int, x int, region_id int")
    pts = spark.createDataFrame([(1, 0, 4.0, 4.0), (2, 0, 25.0, 25.0), (3, 0, 5.4, 6.0)], "cell_id long, slice_id int, x double, y double")
    got = {r.cell_id: r.mapping_status for r in mapping.look_up_slice(pts, lab, 20, 20).collect()}
    assert got == {1: "outside_registered_slice", 2: "outside_slice_bounds", 3: "ok"}


@pytest.mark.parametrize(("zs", "oks", "outliers"), [([200, 205, 210, 240, 220, 225, 230], None, 1), ([200, 205, 210, 215, 222, 225], None, 0), ([200, 999, 210], [True, False, True], 0), ([250], None, 0)])
def test_continuity(spark, zs, oks, outliers):
    rows = [(0, i, z, ok) for i, (z, ok) in enumerate(zip(zs, oks or [True] * len(zs), strict=True))]
    out = series.smooth(spark.createDataFrame(rows, "series int, slice_id int, best_z int, registration_ok boolean")).collect()
    assert len(out) == len(zs)
    n = sum(r.is_outlier for r in out)
    assert n >= 1 if outliers else n == 0


def test_suppression_equals_the_sequential_rule(spark):
    r = random.Random(3)
    pts = [(i, r.randint(0, 2), r.random() * 60, r.random() * 60, float(r.randint(0, 5))) for i in range(300)]
    kept = []
    for p in sorted(pts, key=lambda p: (-p[4], p[0])):
        if all(q[1] != p[1] or (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 > 36 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(pts, "cell_id long, slice_id int, x double, y double, score double")
    out = dedup.suppress(df, dedup.near_pairs(df, r_xy=6.0, group=["slice_id"]))
    assert {x.cell_id for x in out.where("kept").collect()} == {p[0] for p in kept}
    assert {x.cell_id for x in dedup.thin(df, r_xy=6.0, group=["slice_id"]).where("kept").collect()} == {p[0] for p in kept}
    deep = df.withColumn("z", F.col("slice_id") * 4.0).withColumn("g", F.lit(1))
    pairs = dedup.near_pairs(deep, r_xy=6.0, group=["g"], r_z=5.0)
    assert {x.cell_id for x in dedup.thin(deep, r_xy=6.0, group=["g"], r_z=5.0).where("kept").collect()} == {x.cell_id for x in dedup.suppress(deep, pairs).where("kept").collect()}
    odd = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.0), (2, 0, 1.0, 1.0, None), (3, 0, None, 1.0, 1.0), (4, None, 1.0, 1.0, 1.0), (5, 0, float("nan"), 1.0, 1.0), (6, 0, 7.0, 1.0, 0.0)], df.schema)
    assert {x.cell_id for x in dedup.thin(odd, r_xy=6.0, group=["slice_id"]).where("kept").collect()} == {1, 3, 4, 5}
    spot = spark.range(20_000).selectExpr("id cell_id", "0 slice_id", "id % 7 * 0.1D x", "id % 5 * 0.1D y", "cast(id as double) score")
    assert [x.cell_id for x in dedup.thin(spot, r_xy=6.0, group=["slice_id"]).where("kept").collect()] == [19_999]
    none = df.where("false")
    assert dedup.thin(none, r_xy=6.0, group=["slice_id"]).count() == 0
    assert dedup.stats(dedup.suppress(none, dedup.near_pairs(none, r_xy=6.0, group=["slice_id"]))).first().before == 0


def test_knn_equals_brute_force(spark):
    from stratiform.operators.knn import knn_join

    r = random.Random(8)
    # clusters, points at one place, a far one, a group of two, a group on one side only, points without a place
    spot = lambda: r.choice([(5.0, 5.0), (r.gauss(50, 1), r.gauss(50, 1)), (r.random() * 100, r.random() * 100)])
    a = [(i, i % 2, *spot()) for i in range(150)] + [(900, 0, 1e6, -1e5), (901, 2, 0.0, 0.0), (902, 3, 0.0, 0.0), (903, 0, None, 1.0), (904, 0, float("nan"), 1.0)]
    b = [(i, i % 2, *spot()) for i in range(400)] + [(500, 2, 1.0, 0.0), (501, 2, 3.0, 0.0), (502, 4, 0.0, 0.0), (503, 0, None, 0.0)]
    want = set()
    for i, g, x, y in a:
        if x is not None and x == x:
            near = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, h, u, v in b if h == g and u is not None)[:5]
            want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    schema = "id long, g int, x double, y double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert {(t.a, t.b, t.k) for t in knn_join(left, right, "g", 5).collect()} == want
    assert knn_join(left.where("false"), right, "g", 5).count() == knn_join(left, right.where("false"), "g", 5).count() == 0


def test_mode_and_islands_on_a_small_image(spark):
    img = np.array([[1, 1, 1, 2], [1, 3, 1, 2], [1, 1, 2, 2]])
    df = spark.createDataFrame([(0, y, x, int(img[y, x])) for y, x in np.ndindex(3, 4)], "slice_id int, y int, x int, region_id int")
    modes = {(t.y, t.x): t["mode"] for t in raster.mode3(df, ["slice_id"]).collect()}
    for y, x in np.ndindex(3, 4):
        v, c = np.unique(img[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2], return_counts=True)
        assert modes[y, x] == v[c.argmax()]
    left = {(t.y, t.x): t.region_id for t in kernels.remove_islands(df, ["slice_id"], 2).collect()}
    assert left[1, 1] == 1 and left[2, 2] == 2
    f1 = kernels.boundary_f1(df.withColumnRenamed("region_id", "v"), df.withColumnRenamed("region_id", "v"), ["slice_id"], 0).first()
    assert (f1.precision, f1.recall, f1.f1) == (1.0, 1.0, 1.0)


def test_components_and_harmonic_field(spark):
    lab = kernels.label_components(np.array([[1, 1, 0], [0, 1, 0], [2, 0, 1]]))
    assert len(np.unique(lab[lab > 0])) == 3
    line = spark.createDataFrame([(0, y, x, float(x)) for y in range(5) for x in (0, 4)], "z int, y int, x int, value double")
    got = {(r.y, r.x): r.value for r in kernels.laplace_field(line, ["z"], (5, 5)).collect()}
    assert all(abs(v - x) < 1e-3 for (_, x), v in got.items())


def test_files_round_trip(spark, tmp_path):
    img = (np.arange(12).reshape(3, 4) * 100).astype("uint16")
    (tmp_path / "a.tif").write_bytes(files.encode_tiff(img))
    got = files.read_tiff(spark, str(tmp_path / "a.tif")).collect()
    assert {(r.y, r.x): r.value for r in got} == {(y, x): float(img[y, x]) for y in range(3) for x in range(4)}
    vol = np.arange(24).reshape(2, 3, 4).astype("int16")
    (tmp_path / "v.nii").write_bytes(files.encode_nifti(vol, (0.025, 0.005, 0.005)))
    rows = files.read_nifti(spark, str(tmp_path / "v.nii")).collect()
    assert {(r.z, r.y, r.x): r.value for r in rows} == {i: float(vol[i]) for i in np.ndindex(2, 3, 4)}


def test_structure_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿id,name,acronym,parent_id,color\n1,a,A,,FF0000\n2,b,B,1,00FF00\nx,bad,,,\n", encoding="utf-8")
    s = files.structure_csv(spark, str(tmp_path / "s.csv"))
    assert [(r.id, r.structure_id_path, r.parent_structure_id) for r in s.collect()] == [(1, "/1/", None), (2, "/2/", 1)]
    assert {(r.id, r.parent_name) for r in files.parent_names(s).collect()} == {(1, ""), (2, "a")}
    j = files.structure_json(spark.createDataFrame([('{"7": {"name": "n", "acronym": "N", "color": "0000FF"}}',), ("oops",)], "doc string"))
    assert [(r.id, r.depth) for r in j.collect()] == [(7, 0)]


def test_progress_stream(spark, tmp_path):
    lines = [("j", 1, "[PROGRESS:step=2/6:phase=load:slices=4/9] a"), ("j", 2, "plain"), ("j", 3, "[PROGRESS:step=3/6:phase=detect] b")]
    spark.createDataFrame(lines, "job_id string, seq long, value string").write.parquet(str(tmp_path / "in"))
    q = progress.start(spark.readStream.schema("job_id string, seq long, value string").parquet(str(tmp_path / "in")), "folded")
    try:
        q.processAllAvailable()
        r = spark.sql("select * from folded").first()
    finally:
        q.stop()
    assert (r.step, r.phase, r.slices_done, r.slices_total, r.message, r.lines) == (3, "detect", 4, 9, "b", 3)


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(text.job_id(F.lit("--a b/c__"))).first()[0] == "a-b-c"
    assert one.select(text.job_id(F.lit(None))).first()[0] == "default"
    assert one.select(raster.tile_starts(F.lit(4), 2, 0)).first()[0] == [0, 2]
    assert one.select(text.hex_rgb(F.lit("zz0000"))).first()[0] is None
    assert tuple(one.select(validate.sampling_mode(F.lit("merge5"), F.lit(None).cast("int"))).first()[0]) == ("merged", 5)
    ids = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert control.next_free_id(ids).first()[0] == 3
    assert control.next_free_id(ids.where("false")).first()[0] == 1
