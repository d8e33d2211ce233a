"""Strokes, matte, workbook and incremental runs against plain versions."""

import random
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import incremental, strokes
from stratiform.sources import workbook

LOG = "k int, seq int, kind string, x1 double, y1 double, x2 double, y2 double, radius double, strength double"


def frame(spark, shape, k=1):
    return spark.createDataFrame([(k, y, x) for y in range(shape[0]) for x in range(shape[1])], "k int, y int, x int")


def random_log(r, n, shape):
    out = []
    for i in range(n):
        if r.random() < 0.3:
            out.append((1, i, "undo", None, None, None, None, None, None))
        else:
            x, y = r.uniform(0, shape[1]), r.uniform(0, shape[0])
            out.append((1, i, "drag", x, y, x + r.uniform(-6, 6), y + r.uniform(-6, 6), r.choice([None, 3.0, 12.0, 500.0]), r.choice([None, 0.4, 9.0])))
    return out + [(1, n, "drag", 5.0, 5.0, 5.1, 5.1, None, None), (1, n + 1, "drag", None, 5.0, 9.0, 9.0, None, None)]


def replayed(log):
    held = []
    for _, _, kind, x1, y1, x2, y2, radius, strength in log:
        if kind == "undo":
            held = held[:-1]
        else:
            held.append((x1, y1, x2, y2, min(max(radius or 80.0, 8.0), 260.0), min(max(strength or 0.72, 0.05), 1.5)))
    return [s for s in held if s[0] is not None and np.hypot(s[2] - s[0], s[3] - s[1]) >= 0.75]


def pull(s, y, x):
    x1, y1, x2, y2, radius, strength = s
    reach, width = 1.65 * radius, max(4.0, 0.46 * radius)
    w = np.where((abs(y - y1) <= reach) & (abs(x - x1) <= reach), strength * np.exp(-0.5 * ((y - y1) ** 2 + (x - x1) ** 2) / width**2), 0.0)
    return (y2 - y1) * w, (x2 - x1) * w


def test_composed_field_equals_one_stroke_after_another(spark):
    r = random.Random(7)
    shape = (24, 30)
    for _ in range(3):
        log = random_log(r, 9, shape)
        held = replayed(log)
        live = strokes.live_strokes(spark.createDataFrame(log, LOG).repartition(3), ["k"])
        assert len(live.first().strokes) == len(held)
        got = strokes.composed_field(frame(spark, shape), live, ["k"]).toPandas()
        y, x = got["y"].to_numpy(float), got["x"].to_numpy(float)
        for s in reversed(held):  # the last stroke asks first
            v, u = pull(s, y, x)
            y, x = y + v, x + u
        assert np.allclose(got["v"], y - got["y"]) and np.allclose(got["u"], x - got["x"])


def test_pushed_label_and_summed_field(spark):
    shape = (24, 30)
    live = strokes.live_strokes(spark.createDataFrame([(1, 0, "drag", 10.0, 10.0, 14.0, 12.0, 8.0, 1.0), (1, 1, "drag", 20.0, 12.0, 60.0, 12.0, 20.0, 1.5)], LOG), ["k"])
    px = frame(spark, shape)
    flow = strokes.summed_field(px.withColumn("t", (F.col("y") < 18).cast("int")), live, ["k"], "t").toPandas()
    assert np.hypot(flow["v"], flow["u"]).quantile(0.995) <= 6.0 + 1e-6 and (flow[flow["y"] > 23 - 1]["u"].abs() < 0.2).all()
    label = px.withColumn("region_id", F.col("x") + 100 * F.col("y"))
    out = strokes.pushed(label, spark.createDataFrame(flow), ["k"]).toPandas()
    at = flow.set_index(["y", "x"])
    for p in out.itertuples():
        y, x = (int(np.rint(min(max(a + at.loc[(p.y, p.x), m], 0), n - 1))) for a, m, n in ((p.y, "v", shape[0]), (p.x, "u", shape[1])))
        assert p.region_id == x + 100 * y
    assert len(out) == shape[0] * shape[1]


def test_matte_equals_plain_flood(spark):
    r = np.random.default_rng(3)
    h, w = 20, 26
    a = np.full((h, w, 3), 240.0) + r.normal(0, 3, (h, w, 3))
    a[5:15, 6:20] = [150, 80, 160]
    a[8:11, 10:14] = 240  # a hole
    a[4, 6:20] = 225
    d = np.sqrt(((a - [np.median(np.concatenate([a[0, :, c], a[-1, :, c], a[1:-1, 0, c], a[1:-1, -1, c]])) for c in range(3)]) ** 2).sum(2))
    seen, todo = np.zeros((h, w), bool), [(y, x) for y in range(h) for x in range(w) if (y in (0, h - 1) or x in (0, w - 1)) and d[y, x] < 40]
    for p in todo:
        seen[p] = True
    while todo:
        y, x = todo.pop()
        for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= q[0] < h and 0 <= q[1] < w and not seen[q] and d[q] < 40:
                seen[q] = True
                todo.append(q)
    want = np.where(seen, np.clip((d - 12) / 28, 0, 1), 1.0)
    px = spark.createDataFrame([(1, y, x, *map(float, a[y, x])) for y in range(h) for x in range(w)], "k int, y int, x int, r double, g double, b double")
    got = strokes.matte(px, ["k"], ["r", "g", "b"], tile=7).toPandas()
    out = np.zeros((h, w))
    out[got.y, got.x] = got.alpha
    assert np.allclose(out, want) and out[9, 11] == 1.0 and out[0, 0] < 0.2


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def cells(path, i):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        rows = ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).find(f"{NS}sheetData")
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find(f"{NS}sheets")]
    value = lambda c: c.findtext(f"{NS}is/{NS}t") if c.get("t") == "inlineStr" else (None if c.find(f"{NS}v") is None else float(c.findtext(f"{NS}v")))
    return names, [[value(c) for c in row] for row in rows]


def test_workbook_is_read_back_cell_by_cell(spark, tmp_path):
    rows = [(i, f"name {i} <&> \"é\"\n", i / 7, None if i % 3 else i % 2 == 0) for i in range(500)] + [(500, None, float("nan"), None)]
    big = spark.createDataFrame(rows, "id int, `na.me` string, share double, even boolean").repartition(7)
    few = spark.createDataFrame([("k", "v\x01")], "key string, value string")
    path = f"{tmp_path}/out.xlsx"
    for _ in range(2):  # the second one replaces the first
        workbook.write_workbook({"Hierarchy": (big, ["id"]), "Leaf": (big.where("false"), ["id"]), "Run & params": (few, ["key"])}, path)
    names, got = cells(path, 1)
    assert names == ["Hierarchy", "Leaf", "Run & params"] and got[0] == ["id", "na.me", "share", "even"]
    for (i, name, share, even), row in zip(rows[:-1], got[1:-1], strict=True):
        assert row[:2] == [i, name] and abs(row[2] - share) < 1e-12 and row[3] == (None if even is None else float(even))
    assert got[-1] == [500.0, None, "NaN", None]
    assert cells(path, 2)[1] == [["id", "na.me", "share", "even"]] and cells(path, 3)[1] == [["key", "value"], ["k", "v"]]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.xlsx"]


def test_only_changed_keys_run_again(spark, tmp_path):
    work = {"n": []}

    def count(df):
        work["n"].append(sorted(r.k for r in df.select("k").distinct().collect()))
        return df.groupBy("k").agg(F.sum("v").alias("s"))

    stages = lambda setting="": [incremental.Stage("keep", lambda df: df.where("v > 0")), incremental.Stage("sum", count, setting)]
    rows = [(k, v) for k in range(5) for v in range(-2, 4)]
    df = lambda more=(): spark.createDataFrame([*rows, *more], "k int, v int").repartition(3)
    run = lambda d, s="": incremental.Run(spark, f"file://{tmp_path}/run", "k").all(stages(s), d)
    told = lambda t, name: sorted(r.k for r in t.where(f"stage = '{name}' and redone").collect())
    out, t = run(df())
    assert sorted((r.k, r.s) for r in out.collect()) == [(k, 6) for k in range(5)] and told(t, "keep") == told(t, "sum") == list(range(5))
    out, t = run(df())
    assert told(t, "keep") == told(t, "sum") == [] and work["n"][-1] == [] and out.count() == 5
    out, t = run(df([(2, 10), (3, -7), (9, 1)]))
    assert told(t, "keep") == [2, 3, 9] and told(t, "sum") == [2, 9] and sorted((r.k, r.s) for r in out.collect()) == [(0, 6), (1, 6), (2, 16), (3, 6), (4, 6), (9, 1)]
    out, t = run(df().where("k <> 4"), "other settings")
    assert told(t, "keep") == [2, 3] and told(t, "sum") == [0, 1, 2, 3] and out.count() == 4
    import shutil

    last = max((tmp_path / "run" / "sum").iterdir(), key=lambda p: int(p.name[1:]))
    shutil.rmtree(last / "marks")  # the run broke off within this stage
    out, t = run(df().where("k <> 4"), "other settings")
    assert told(t, "keep") == [] and told(t, "sum") == [0, 1, 2, 3] and sorted((r.k, r.s) for r in out.collect()) == [(k, 6) for k in range(4)]


@pytest.mark.parametrize("n", [0, 1])
def test_no_strokes_move_nothing(spark, n):
    live = strokes.live_strokes(spark.createDataFrame([(1, 0, "undo", *[None] * 6)] + [(1, 1, "drag", 1.0, 1.0, 1.2, 1.2, None, None)] * n, LOG), ["k"])
    got = strokes.composed_field(frame(spark, (3, 3)), live, ["k"])
    assert got.count() == 9 and got.where("v <> 0 or u <> 0").count() == 0


def test_long_logs_of_many_images(spark):
    """strokes that hold are found without copying the held ones at each row, and images with few and many strokes or pixels are carried together."""
    r = random.Random(11)
    shapes = {1: (70, 5), 2: (4, 4), 3: (9, 30), 4: (2, 3)}
    logs = {k: [(k, *row[1:]) for row in random_log(r, n, shapes[k])] for k, n in ((1, 40), (2, 300), (3, 7), (4, 0))}
    logs[2] += [(2, i, "undo", *[None] * 6) for i in range(400, 620)] + [(2, i, "drag", 1.0, 2.0, 3.0, 1.0, 8.0, 0.5) for i in range(700, 705)] * 2
    live = strokes.live_strokes(spark.createDataFrame(sum(logs.values(), []), LOG).repartition(3), ["k"])
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "unboundedfollowing" not in plan.lower()
    px = frame(spark, shapes[1])
    for k in (2, 3, 4):
        px = px.union(frame(spark, shapes[k], k))
    got = strokes.composed_field(px, live, ["k"]).toPandas()
    assert len(got) == sum(h * w for h, w in shapes.values())
    for k, log in logs.items():
        held, one = replayed(sorted(log, key=lambda row: row[1])), got[got["k"] == k]
        assert len(live.where(f"k = {k}").first().strokes) == len(held)
        y, x = one["y"].to_numpy(float), one["x"].to_numpy(float)
        for s in reversed(held):
            v, u = pull(s, y, x)
            y, x = y + v, x + u
        assert np.allclose(one["v"], y - one["y"]) and np.allclose(one["u"], x - one["x"])
    groups = list(strokes._alike(np.array([256] * 200), np.arange(200)))
    assert sorted(sum(groups, [])) == list(range(200)) and max(len(g) for g in groups) == strokes.TOGETHER // 256
