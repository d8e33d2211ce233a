"""What shows on larger tables only: sides of joins that are exploded from small files, deep stacks, long numbers, equal scores."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratiform import registry
from stratiform.operators import dedup, detection, filters, flow, kernels, knn, placement, raster, strokes, tiles
from stratiform.sources import files, pixels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, folder, rows):
    """A folder with an events table alone."""
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(1700000000 + event_id) ts", "user_id", "event_type", "value", "'{}' props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    rel = con.sql(registry.oracle_sql()[name])
    return sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_radius_join_in_depth_meets_near_layers_only(spark):
    """F2."""
    points = [(i, (i * 7) % 5 * 1.0, (i * 3) % 4 * 1.0, i * 13 % 40) for i in range(120)]
    df = spark.createDataFrame(points, "cell_id long, x double, y double, slice_id int").selectExpr("*", "slice_id * 10.0D z", "0 block")
    out = dedup.near_pairs(df, r_xy=4.0, group=["block"], r_z=12.5, neighbor_slices=1)
    d2 = lambda a, b, n: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) / 16 + ((a[3] - b[3]) * 10 / n) ** 2
    assert sorted((r.a, r.b) for r in out.collect()) == [(a[0], b[0]) for a in points for b in points if a[0] < b[0] and abs(a[3] - b[3]) <= 1 and d2(a, b, 12.5) <= 1]
    free = dedup.near_pairs(df, r_xy=4.0, group=["block"], r_z=25.0)
    assert sorted((r.a, r.b) for r in free.collect()) == [(a[0], b[0]) for a in points for b in points if a[0] < b[0] and d2(a, b, 25.0) <= 1]
    assert all(re.search(r"SortMergeJoin \[[^\]]*gz", plan(o)) for o in (out, free))


def test_cells_over_seams_are_not_broadcast(spark):
    """F3."""
    masks = spark.createDataFrame([(t, c, y, x - 20) for t in (1, 2) for c in (5, 6) for y in range(3) for x in range(c * 10, c * 10 + 12 - 7 * (t == 2))] + [(1, 5, 0, 30), (3, 7, 90, -70)], "tile int, cell int, y int, x int").selectExpr("0 image", "*")
    out = tiles.one_of_each_cell(masks, ["image"])
    assert sorted((r.tile, r.cell, r.area, r.parts) for r in out.collect()) == [(1, 5, 36, 2), (1, 6, 36, 2), (3, 7, 1, 1)]
    assert "Broadcast" not in plan(out)


def test_neighbours_are_not_broadcast(spark):
    """F4."""
    e = spark.range(60).selectExpr("id", "id % 2 g", "cast(id * 7 % 31 as double) x", "cast(id % 9 as double) y")
    out = knn.knn_join(e, e.withColumn("x", e.x + 0.25), "g", 3)
    assert out.count() == 180 and "Broadcast" not in plan(out)


def test_pixels_of_strokes_are_not_broadcast(spark):
    """F5."""
    log = spark.range(40).selectExpr("id % 4 k", "id seq", "'drag' kind", "id % 16 x1", "id % 13 y1", "id % 16 + 2 x2", "id % 13 - 1 y2", "8 radius", "0.5D strength")
    px = spark.range(4 * 256).selectExpr("id div 256 k", "cast(id % 256 div 16 as int) y", "cast(id % 16 as int) x")
    for field in (strokes.composed_field, strokes.summed_field):
        assert "Broadcast" not in plan(field(px, strokes.live_strokes(log, ["k"]), ["k"]))


@pytest.mark.parametrize("name", ["e03_file_names", "e05_names"])
def test_long_numbers_in_names(spark, tmp_path, name):
    """user_id of five digits and more."""
    d = events(spark, tmp_path, [(i, u, "view", 1.0) for i, u in enumerate([3, 9995, 9996, 9999, 10000, 12345, 89999, 1234567])])
    assert same_as_sql(spark, d, name)


def test_equal_scores_are_dispatched_in_order(spark, tmp_path):
    """F8."""
    d = events(spark, tmp_path, [(i, 1 + 3 * (i // 8), "view", 5.0 + i % 2) for i in range(400)])
    assert same_as_sql(spark, d, "m20_dispatch")
    cells = spark.createDataFrame([(s, 1.0 * x, 0.0, 7.0, "view") for s in range(30) for x in range(3)], "slice_id int, x double, y double, score double, detector string")
    kept = detection.dispatch(cells, None, None, radius=2.0)
    assert {(r.slice_id, r.x) for r in kept.collect()} == {(s, 0.0) for s in range(30)}


def test_small_blocks_share_calls(spark, monkeypatch):
    """Points of different blocks don't see one another, however many blocks a call holds."""
    at, rank, no = np.zeros((4, 2)), -np.arange(4.0), np.zeros(4, bool)
    assert dedup.settled(at, np.array([6.0, 6.0]), True, rank, no, no, np.array([0, 1, 0, 1])).tolist() == [1, 1, -1, -1]
    df = spark.range(600).selectExpr("id cell_id", "cast(id % 40 as int) slice_id", "cast(id * 37 % 701 as double) x", "cast(id * 11 % 13 as double) y", "cast(id * 7 % 5 as double) score")
    want = {(r.cell_id, r.kept) for r in dedup.suppress(df, dedup.near_pairs(df, r_xy=6.0, group=["slice_id"])).collect()}
    for points in (1, 100_000):
        monkeypatch.setattr(dedup, "CALL_POINTS", points)
        assert {(r.cell_id, r.kept) for r in dedup.thin(df, r_xy=6.0, group=["slice_id"]).collect()} == want


def test_a_task_is_one_value_of_state():
    """one read and one write of the state store a task and batch."""
    pytest.importorskip("google.protobuf")
    from pyspark.sql import Row

    from stratiform.streaming import jobs

    calls = []

    class Store:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, v):
            calls.append("update")
            self.value = v

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Store()

        def registerTimer(self, ms):  # noqa: N802
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    t = jobs.TaskRegistry()
    t.init(Handle())
    rows = [Row(seq=i, kind="progress", percent=i, message=f"m{i}", at_ms=i) for i in range(50)]
    assert [r.percent for r in t.handleInputRows(("a",), iter(rows), Times())] == [49] and calls == ["get", "update"]
    out = list(t.handleInputRows(("a",), iter([Row(seq=20, kind="cancel", percent=None, message=None, at_ms=60)]), Times()))
    assert [(r.status, r.percent, r.events) for r in out] == [("cancelled", 19, 51)] and calls[2:] == ["get", "timer", "update"]


def test_boundaries_travel_by_images(spark):
    """an image's pixels cross the network as bytes, once, and are joined and sorted nowhere."""
    r = np.random.default_rng(4)
    a, b = r.integers(0, 3, (2, 3, 9, 11))
    a[2], b[2] = 1, 1
    rows = lambda v: spark.createDataFrame([(*map(int, p), int(v[p])) for p in np.ndindex(*v.shape)], "k int, y int, x int, v int")
    out = kernels.boundary_f1(rows(a), rows(b), ["k"], 1)
    assert not re.search("Window|Join", plan(out)) and plan(out).count("Exchange hashpartitioning") == 1
    edge = lambda v: {(y, x) for y in range(8) for x in range(10) if v[y, x] != v[y, x + 1] or v[y, x] != v[y + 1, x]}
    share = lambda e, g: sum(any(abs(y - q) <= 1 and abs(x - w) <= 1 for q, w in g) for y, x in e) / len(e) if e else 0.0
    got = {t.k: t for t in out.collect()}
    for k in range(3):
        e, g = edge(a[k]), edge(b[k])
        assert abs(got[k].precision - share(e, g)) < 1e-12 and abs(got[k].recall - share(g, e)) < 1e-12
    assert got[2].f1 == 0.0


def test_images_of_mixed_rows(spark):
    """The step that F10 to F18 share: images whose pixels come in any order, with null keys and values."""
    px = spark.range(3000).selectExpr("case when id % 7 = 0 then null else id % 7 end k", "cast(id % 2 as string) t", "cast(id as int) y", "0 x", "case when id % 3 = 0 then null else id end v")
    sums = lambda key, pdf: pd.DataFrame({"k": [key[0]], "t": [key[1]], "n": [len(pdf)], "s": [int(pdf["v"].sum())]})
    got = kernels.by_image(px.repartition(3), ["k", "t"], sums, "k long, t string, n long, s long").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, px.groupBy("k", "t").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()))


def test_modes_and_outlines_travel_by_images(spark):
    """F13, F18."""
    lab = np.random.default_rng(6).integers(0, 3, (2, 7, 6))
    df = spark.createDataFrame([(*map(int, p), int(lab[p])) for p in np.ndindex(*lab.shape)], "k int, y int, x int, region_id int")
    modes, lines = raster.mode3(df, ["k"]), raster.outlined(df.selectExpr("*", "7 r", "8 g", "9 b"), ["k"])
    for out in (modes, lines):
        assert not re.search("Window|Join", plan(out)) and plan(out).count("Exchange hashpartitioning") == 1
    assert modes.count() == lines.count() == lab.size
    for t in modes.collect():
        near = lab[t.k, max(0, t.y - 1) : t.y + 2, max(0, t.x - 1) : t.x + 2].ravel().tolist()
        assert t["mode"] == min(near, key=lambda v: (-near.count(v), v))
    for t in lines.collect():
        beside = [lab[t.k, q, w] for q, w in ((t.y - 1, t.x), (t.y + 1, t.x), (t.y, t.x - 1), (t.y, t.x + 1)) if 0 <= q < 7 and 0 <= w < 6]
        on = t.region_id > 0 and any(v != t.region_id for v in beside)
        assert (t.r, t.g, t.b) == ((255, 255, 255) if on else (7, 8, 9)) and t.region_id == lab[t.k, t.y, t.x]


def test_kernels_do_the_same_with_less(spark, monkeypatch):
    """components by runs, nearest pixels where they are asked for, both flows at once, and no placement scored twice."""
    r = np.random.default_rng(8)
    for corners in (False, True):
        a = r.integers(0, 3, (13, 17))
        got = kernels.label_components(a, corners)
        steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * corners
        want = np.where(a > 0, np.arange(1, a.size + 1).reshape(a.shape), 0)
        for _ in range(a.size):
            for y, x in np.ndindex(*a.shape):
                for dy, dx in steps:
                    q, w = y + dy, x + dx
                    if q < 13 and 0 <= w < 17 and a[y, x] == a[q, w] > 0:
                        want[y, x] = want[q, w] = min(want[y, x], want[q, w])
        assert (got == want).all()
    mask = r.random((20, 30)) < 0.05
    ys, xs = np.nonzero(~mask)
    assert all((p[ys, xs] == q).all() for p, q in zip(filters.nearest_set(mask), filters.nearest_to(mask, ys, xs), strict=True))
    a, b = r.random((2, 40, 36))
    both = flow.total_variation_flows(np.array([[a, b], [b, a]]), steps=3, warps=2)
    assert all((np.array(flow.total_variation_flow(*p, steps=3, warps=2)) == q).all() for p, q in zip(((a, b), (b, a)), both, strict=True))
    y, x = np.indices((64, 64))
    real, lab = np.where((x - 32) ** 2 + (y - 32) ** 2 < 484, 220.0, 2.0), ((x - 33) ** 2 + (y - 32) ** 2 < 484).astype(int)
    calls, plain = [], placement.between
    monkeypatch.setattr(placement, "between", lambda w: calls.append(w.tobytes()) or plain(w))
    placement.similarity_search(real, lab, stride=1)
    assert calls and len(calls) == len(set(calls))


def test_planes_share_a_solve(spark):
    """many planes are one call's work, and each is what it is alone."""
    r = np.random.default_rng(9)
    known = r.random((6, 5, 7)) < 0.3
    known[:, 0, 0] = True
    known[2] = True
    value = np.where(known, r.random(known.shape), 0.0)
    every = kernels.laplace_fields(known, value, 1e-8, 2000)
    assert all(np.abs(kernels.laplace_fields(k[None], v[None], 1e-8, 2000)[0] - e).max() < 1e-9 for k, v, e in zip(known, value, every, strict=True))
    assert (every[known] == value[known]).all()
    p = np.pad(every, [(0, 0), (1, 1), (1, 1)], "edge")
    off = np.abs(p[:, 2:, 1:-1] + p[:, :-2, 1:-1] + p[:, 1:-1, 2:] + p[:, 1:-1, :-2] - 4 * every)
    assert off[~known].max() < 1e-6
    df = spark.createDataFrame([(*map(int, q), float(value[tuple(q)])) for q in np.argwhere(known)], "k int, y int, x int, value double")
    out = kernels.laplace_field(df, ["k"], (5, 7))
    assert "InPandas" not in plan(out)
    assert all(abs(t.value - every[t.k, t.y, t.x]) < 1e-5 for t in out.collect())


def test_small_files_share_partitions(spark, tmp_path):
    """a partition for many small files and none of them opened for the plan."""
    for i in range(70):
        (tmp_path / f"f{i:03}.tif").write_bytes(files.encode_stack([np.full((2, 3), 10 * i + p, "f4") for p in range(3)]))
    reader = pixels.TiffReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 1
    pixels.register(spark)
    got = spark.read.format("tiff_pixels").load(str(tmp_path)).where("page in (0, 2) and y >= 1").collect()
    assert sorted((r.path[-7:], r.page, r.y, r.x, r.value) for r in got) == [(f"{i:03}.tif", p, 1, x, 10.0 * i + p) for i in range(70) for p in (0, 2) for x in range(3)]
