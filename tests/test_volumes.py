"""Blocked volume solves against a dense solve, and sampling along a field against numpy."""

import numpy as np
import pyarrow as pa
import pytest

from stratiform.operators import volumes
from stratiform.plans import volumes as plans


def dense(shape, known, value, spacing):
    """The harmonic field by one dense system."""
    n = int(np.prod(shape))
    number = np.arange(n).reshape(shape)
    a = np.zeros((n, n))
    for axis, h in enumerate(spacing):
        head, tail = np.moveaxis(number, axis, 0)[1:].ravel(), np.moveaxis(number, axis, 0)[:-1].ravel()
        for i, j in zip(head, tail, strict=True):
            for p, q in ((i, j), (j, i)):
                a[p, p] += 1 / h**2
                a[p, q] -= 1 / h**2
    k = known.ravel()
    out = value.reshape(-1, n).copy()
    out[:, ~k] = np.linalg.solve(a[~k][:, ~k], -(a[~k][:, k] @ out[:, k].T)).T
    return out.reshape(value.shape)


@pytest.mark.parametrize(("shape", "block", "spacing"), [((7, 9, 8), 4, (1.0, 1.0, 1.0)), ((6, 5, 11), 3, (2.5, 1.0, 0.8)), ((5, 1, 6), 8, (1.0, 1.0, 1.0))])
def test_field_equals_dense_solve(spark, shape, block, spacing):
    r = np.random.default_rng(3)
    known = r.random(shape) < 0.05
    known[0, 0, 0] = known[-1, -1, -1] = True
    value = r.standard_normal((3, *shape))
    rows = [(*map(int, p), *map(float, value[(slice(None), *p)])) for p in np.argwhere(known)]
    rows += [(0, 0, 0, *(v + 2.0 for v in rows[0][3:]))]  # two points in one voxel: their mean
    value[:, 0, 0, 0] += 1.0
    df = spark.createDataFrame(rows, "z int, y int, x int, a double, b double, c double")
    got = volumes.harmonic_field(df, ["a", "b", "c"], shape=shape, spacing=spacing, block=block, rtol=1e-9).toPandas()
    assert len(got) == np.prod(shape)
    out = np.zeros((3, *shape))
    out[:, got.z, got.y, got.x] = got[["a", "b", "c"]].to_numpy().T
    assert np.abs(out - dense(shape, known, value, spacing)).max() < 1e-6


def test_field_without_points_or_free_voxels(spark):
    none = spark.createDataFrame([], "z int, y int, x int, a double")
    got = volumes.harmonic_field(none, ["a"], shape=(2, 3, 4), block=2)
    assert got.count() == 24 and got.where("a <> 0").count() == 0
    full = spark.createDataFrame([(0, 0, x, float(x)) for x in range(5)], "z int, y int, x int, a double")
    assert [r.a for r in volumes.harmonic_field(full, ["a"], block=2).orderBy("x").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="no points"):
        volumes.harmonic_field(none, ["a"])


def test_sampling_equals_plain_version(spark):
    r = np.random.default_rng(5)
    shape = (4, 5, 6)
    volume, field = r.standard_normal(shape), r.uniform(-3, 3, (3, *shape))
    field[:, 0, 0, 0] = 0
    want = np.zeros(shape)
    for p in np.ndindex(*shape):
        at = [min(max(i + field[(a, *p)], 0.0), n - 1.0) for a, (i, n) in enumerate(zip(p, shape, strict=True))]
        low = [int(np.floor(v)) for v in at]
        for c in np.ndindex(2, 2, 2):
            w = np.prod([(v - lo) if up else 1 - (v - lo) for v, lo, up in zip(at, low, c, strict=True)])
            want[p] += w * volume[tuple(min(lo + up, n - 1) for lo, up, n in zip(low, c, shape, strict=True))]
    vol = spark.createDataFrame([(*map(int, p), float(volume[p])) for p in np.ndindex(*shape)], "z int, y int, x int, value double")
    flow = spark.createDataFrame([(*map(int, p), *map(float, field[(slice(None), *p)])) for p in np.ndindex(*shape)], "z int, y int, x int, dz double, dy double, dx double")
    got = volumes.sampled(vol, flow, shape).toPandas()
    out = np.zeros(shape)
    out[got.z, got.y, got.x] = got.value
    assert len(got) == volume.size and np.abs(out - want).max() < 1e-9


def test_rounds_carry_faces_only(spark, monkeypatch):
    """what a round writes is of the faces' size, not the volume's, and near known voxels hardly a round is needed."""
    from stratiform.shared import Tables

    written = []
    save = Tables.save

    def note(self, df):
        out = save(self, df)
        if "rr" in out.columns:
            written.append(out.selectExpr("sum(length(r)) n").first().n)
        return out

    monkeypatch.setattr(Tables, "save", note)
    points = spark.range(4000).selectExpr("cast(id div 10 as int) z", "cast(id div 3 % 8 as int) y", "cast(id * 7 % 8 as int) x", "cast(id * 37 % 101 as double) a")
    assert volumes.harmonic_field(points, ["a"], block=8).count() == 400 * 64
    assert len(written) <= 6 and max(written) < 400 * 64 * 8 / 20


def test_planes_are_the_field_packed(spark):
    """planes of blocks as arrays hold what the voxels' rows hold, and a batch's blocks are spelled out one at a time."""
    r = np.random.default_rng(7)
    rows = [(int(z), int(y), int(x), float(v), float(-v)) for z, y, x, v in zip(r.integers(0, 21, 90), r.integers(0, 5, 90), r.integers(0, 7, 90), r.standard_normal(90), strict=True)]
    df = spark.createDataFrame(rows, "z int, y int, x int, a double, b double")
    field = volumes.harmonic_field(df, ["a", "b"], shape=(21, 5, 7), block=4).toPandas()
    want = np.full((2, 21, 5, 7), np.nan)
    want[:, field.z, field.y, field.x] = field[["a", "b"]].to_numpy().T
    got = np.full_like(want, np.nan)
    planes = volumes.harmonic_planes(df, ["a", "b"], shape=(21, 5, 7), block=4).collect()
    assert len(planes) == 21 * 2 * 2
    for p in planes:
        a = np.array([p.a, p.b]).reshape(2, -1, p.width)
        got[:, p.z, p.y : p.y + a.shape[1], p.x : p.x + p.width] = a
    assert np.array_equal(got, want) and not np.isnan(got).any()
    batch = pa.RecordBatch.from_pylist([{"n": i, "x": bytes([i])} for i in range(3)])
    assert next(rows := volumes._rows([batch])) == {"n": 0, "x": b"\0"} and len(list(rows)) == 2


def test_check_of_the_field_is_packed_and_sees_faults(spark, tmp_path):
    """F1: no voxel travels as a row, and a plane that isn't harmonic, or is missing, is told."""
    spark.range(3000).selectExpr("id event_id", "timestamp_seconds(id) ts", "id % 7 user_id", "'view' event_type", "cast(id % 101 as double) value", "'{}' props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = plans.QUERIES["m23_volume_field"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan and df.where("harmonic and voxels = 576").count() == 75
    n = plans.SIDE * plans.SIDE

    def summary(values):
        planes = pa.table({"z": pa.array(list(values), pa.int32()), "y": [0] * len(values), "x": [0] * len(values), "width": [plans.SIDE] * len(values), "a": [[v] * n for v in values.values()], "b": [[1.0] * n] * len(values)})
        marks = pa.table({"z": [1], "y": [0], "x": [0]})
        return plans._slab_summary((pa.scalar(0),), planes, marks).to_pydict()

    assert summary({0: 2.0, 1: 2.0, 2: 2.0}) == {"z": [0, 1, 2], "voxels": [n] * 3, "known": [0, 1, 0], "a": [0.0, 2.0, 0.0], "b": [0.0, 1.0, 0.0], "off": [0.0] * 3}
    assert summary({0: 2.0, 1: 2.5, 2: 2.0})["off"] == [0.5, 1.0, 0.5]
    assert summary({0: 2.0, 2: 2.0})["voxels"] == [n, n] and all(np.isnan(summary({0: 2.0, 2: 2.0})["off"]))
