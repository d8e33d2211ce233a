"""Kernels that SQL can't express, against brute force and planted answers."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import detection, filters, flow, kernels, landmarks, placement, runs
from stratiform.sources import files


def disc(n=64, r=20, cy=32, cx=32):
    y, x = np.indices((n, n))
    return (y - cy) ** 2 + (x - cx) ** 2 < r * r


def dice(a, b):
    return 2 * (a & b).sum() / (a.sum() + b.sum())


def test_nearest_set_equals_brute_force():
    r = np.random.default_rng(0)
    for _ in range(5):
        m = r.random((17, 23)) < 0.05
        m[3, 4] = True
        d, y, x = filters.nearest_set(m)
        at = np.argwhere(m)
        gy, gx = np.indices(m.shape)
        want = np.sqrt(((gy[..., None] - at[:, 0]) ** 2 + (gx[..., None] - at[:, 1]) ** 2).min(-1))
        assert np.allclose(d, want) and m[y, x].all() and np.allclose(np.hypot(gy - y, gx - x), want)
    assert np.isinf(filters.nearest_set(np.zeros((3, 3), bool))[0]).all()


def test_morphology():
    m = disc(40, 9, 20, 20)
    holed = m.copy()
    holed[20, 20] = False
    assert (filters.closing(holed, 1) == m).all() or filters.closing(holed, 1)[20, 20]
    dot = m.copy()
    dot[2, 2] = True
    assert not filters.opening(dot, 2)[2, 2]
    assert (filters.erode(m, 2) <= m).all() and (m <= filters.dilate(m, 2)).all()


def test_canny_finds_a_thin_line():
    a = np.zeros((40, 40))
    a[:, 20:] = 100
    e = filters.canny(a, 1.0, 5, 10)
    assert e[5:35].any(1).all() and set(np.unique(np.nonzero(e)[1])) <= {19, 20} and e[5:35].sum(1).max() <= 2
    assert not filters.canny(np.zeros((20, 20)), 1.0, 5, 10).any()


def test_equalise_spreads_values():
    r = np.random.default_rng(1)
    a = 0.4 + 0.05 * r.random((64, 64))
    out = filters.equalise(a, 4, 0.05)
    assert out.min() >= 0 and out.max() <= 1 + 1e-9 and np.ptp(out) > 2 * np.ptp(a)


def test_tissue_is_the_largest_region():
    a = np.zeros((120, 120))
    a[20:80, 30:90] = 200
    a[100:104, 100:104] = 200
    m = filters.tissue(a)
    assert m[50, 60] and not m[101, 101] and abs(int(m.sum()) - 3600) < 200
    assert filters.tissue(np.ones((50, 50))) is None


def test_triangles_are_delaunay():
    r = np.random.default_rng(3)
    pts = r.random((25, 2)) * 100
    tri = landmarks.triangles(pts)
    for t in tri:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        o = np.array([((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d, ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d])
        rad = ((pts[t[0]] - o) ** 2).sum()
        assert all(((pts[i] - o) ** 2).sum() >= rad * (1 - 1e-9) for i in range(len(pts)))


def test_piecewise_and_spline_follow_an_affine_map():
    r = np.random.default_rng(4)
    src = np.vstack([r.random((12, 2)) * 50, [[0, 0], [50, 0], [0, 50], [50, 50]]])
    m, c = np.array([[1.1, 0.2], [-0.1, 0.9]]), np.array([3.0, -2.0])
    dst = src @ m + c
    at = 5 + r.random((30, 2)) * 40
    assert np.allclose(landmarks.piecewise_apply(src, dst, at), at @ m + c)
    assert np.isnan(landmarks.piecewise_apply(src, dst, np.array([[99.0, 99.0]]))).all()
    assert np.allclose(landmarks.spline_apply(landmarks.spline_fit(src, dst), src, at), at @ m + c, atol=1e-6)
    bent = dst + r.normal(size=dst.shape)
    assert np.allclose(landmarks.spline_apply(landmarks.spline_fit(src, bent), src, src), bent, atol=1e-6)


def test_robust_affine_leaves_outliers_out():
    r = np.random.default_rng(5)
    src = r.random((30, 2)) * 100
    dst = src @ np.array([[1.0, 0.1], [-0.1, 1.0]]) + 4 + r.normal(0, 0.5, (30, 2))
    dst[:8] += 40 + 40 * r.random((8, 2))
    ok = landmarks.robust_affine(src, dst)
    assert not ok[:8].any() and ok[8:].all()
    assert landmarks.robust_affine(src[:3], dst[:3]).all()


def test_corners_of_a_square():
    a = np.zeros((60, 60))
    a[20:40, 15:45] = 100
    found = landmarks.corners(a, 4, 5)
    want = {(15, 20), (44, 20), (15, 39), (44, 39)}
    assert len(found) == 4 and all(min(abs(x - u) + abs(y - v) for u, v in want) <= 3 for x, y in found)


def test_flow_recovers_a_shift():
    b = filters.gaussian(np.random.default_rng(6).random((64, 64)), 3)
    b = (b - b.min()) / np.ptp(b)
    a = np.roll(b, (2, -3), (0, 1))
    v, u = flow.total_variation_flow(a, b, attachment=15)
    assert abs(np.median(v[12:-12, 12:-12]) + 2) < 0.4 and abs(np.median(u[12:-12, 12:-12]) - 3) < 0.4


def scene(shift):
    t, lab = disc(), disc(cx=32 + shift)
    x = np.indices(t.shape)[1]
    real = np.where(t, np.where(x < 32, 200.0, 110.0), 4.0)
    return real, np.where(lab, np.where(x < 32 + shift, 1, 2), 0), t


@pytest.mark.parametrize("method", ["flow", "liquify", "silhouette"])
def test_refinement_never_scores_lower_than_the_start(method):
    real, label, t = scene(3)
    before = flow.quality(real, label, t)
    out, q, tag = flow.candidate(method, real, label, t)
    assert out.shape == label.shape and set(np.unique(out)) <= {0, 1, 2} and tag
    if method != "silhouette":
        assert q > before
    assert dice(out > 0, t) > dice(label > 0, t) - 0.02


def test_refine_keeps_the_image_where_nothing_is_better(spark):
    real, label, t = scene(0)
    y, x = (a.ravel().tolist() for a in np.indices(label.shape))
    px = spark.createDataFrame(list(zip([1] * len(y), y, x, real.ravel().tolist(), label.ravel().tolist(), t.ravel().astype(float).tolist(), strict=True)), "k int, y int, x int, real double, region_id int, tissue double")
    r = flow.refine(px, ["k"], ("liquify",), margin=1.0).first()
    assert r.method == "baseline" and r.moved == 0 and r.score_after == r.score_before


def test_splat_field_reaches_its_matches():
    src = np.array([[20.0, 20.0], [40.0, 44.0]])
    v, u = flow.splatted(src, src + np.array([3.0, -2.0]), (64, 64), 5.0, 8.0)
    assert abs(u[20, 20] - 3) < 0.2 and abs(v[44, 40] + 2) < 0.2


def test_contour_conform_meets_the_outline():
    t = disc(120, 40, 60, 60)
    label = np.where(disc(120, 33, 57, 63), 1, 0)
    out = placement.contour_conform(label, t)
    assert dice(out > 0, t) > dice(label > 0, t) + 0.05
    assert (placement.contour_conform(np.zeros((50, 50), int), disc(50, 10, 25, 25)) == 0).all()


def test_similarity_search_finds_the_shift():
    real, label, _ = scene(6)
    scale, angle, dx, dy, score = placement.similarity_search(real, label, stride=1)
    moved = placement.place(label, scale, angle, dx, dy, label.shape)
    assert dice(moved > 0, disc()) > 0.95 > dice(label > 0, disc()) and 0.7 <= scale <= 1.4 and score > 0


def test_cleaned_labels():
    t = disc(120, 50, 60, 60)
    label = np.where(t, np.where(np.indices(t.shape)[1] < 60, 1, 2), 0)
    spoiled = label.copy()
    spoiled[60, 30:33] = 2  # an island
    spoiled[50:53, 80:83] = 0  # a hole
    spoiled[10:25, 50:70] = 0  # missing at the rim
    spoiled[2, 2] = 1  # off the tissue
    out = placement.cleaned(spoiled, t)
    assert (out[50:53, 80:83] == 2).all() and out[2, 2] == 0 and (out[12:24, 55:65] > 0).all()
    assert (out[60, 30:33] == 1).all()
    lab8 = placement._components8(np.eye(5, dtype=bool))
    assert len(np.unique(lab8[lab8 > 0])) == 1


def test_normals_point_outward(spark):
    m = disc(60, 20, 30, 30)
    edge = m & ~filters.erode(m, 1)
    y, x = (a.ravel().tolist() for a in np.indices(m.shape))
    mask = spark.createDataFrame(list(zip([1] * len(y), y, x, m.ravel().astype(float).tolist(), strict=True)), "k int, y int, x int, value double")
    pts = spark.createDataFrame([(1, int(a), int(b)) for a, b in np.argwhere(edge)], "k int, y int, x int")
    rows = placement.oriented_normals(mask, pts, ["k"], 4.0).collect()
    assert len(rows) > 50
    assert all((r.y - 30) * r.ny + (r.x - 30) * r.nx > 0.8 * 17 for r in rows)


def test_blobs_stand_on_bright_spots(spark):
    a = np.zeros((50, 50))
    for y, x in ((12, 15), (33, 36)):
        a += np.exp(-((np.indices(a.shape)[0] - y) ** 2 + (np.indices(a.shape)[1] - x) ** 2) / (2 * 2.5**2))
    y, x = (i.ravel().tolist() for i in np.indices(a.shape))
    px = spark.createDataFrame(list(zip([1] * len(y), y, x, (a.ravel() * 100).tolist(), strict=True)), "k int, y int, x int, value double")
    found = kernels.log_blobs(px, ["k"], threshold=0.1).collect()
    assert {(r.y, r.x) for r in found} == {(12, 15), (33, 36)} and all(abs(r.sigma - 2.5) < 0.6 and abs(r.area_px - np.pi * 2 * r.sigma**2) < 1e-9 for r in found)


def test_components_equal_flood_fill():
    r = np.random.default_rng(7)
    m = r.integers(0, 3, (20, 25))
    lab = kernels.label_components(m)
    seen = np.zeros(m.shape, bool)
    for y, x in np.argwhere(m > 0):
        if seen[y, x]:
            continue
        todo, part = [(y, x)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in part:
                continue
            part.add((a, b))
            todo += [(a + i, b + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= a + i < 20 and 0 <= b + j < 25 and m[a + i, b + j] == m[y, x]]
        assert len({lab[p] for p in part}) == 1 and lab[y, x] == min(a * 25 + b for a, b in part) + 1
        for p in part:
            seen[p] = True
    assert (lab[m == 0] == 0).all()


def greedy(cells, radius):
    kept = []
    for c in cells:
        if all((c[1] - k[1]) ** 2 + (c[2] - k[2]) ** 2 > radius**2 for k in kept):
            kept.append(c)
    return kept


@pytest.mark.parametrize("merge", [False, True])
def test_dispatch_equals_plain_rule(spark, merge):
    r = random.Random(9)
    make = lambda n, det, slices: [(r.choice(slices), r.randint(0, 300) / 10, r.randint(0, 300) / 10, r.randint(1, 10**6) / 10**6, det) for _ in range(n)]
    parts = [make(120, "a", [1, 2]), make(120, "b", [2, 3]), make(60, "c", [1, 2, 3, 4])]
    frames = [spark.createDataFrame(p, "slice_id int, x double, y double, score double, detector string") for p in parts]
    out = detection.dispatch(*frames, merge=merge, allow_fallback=True).collect()
    got = {}
    for c in out:
        got.setdefault(c.slice_id, []).append((c.score, c.x, c.y, c.detector, c.cell_id))
    for s in (1, 2, 3, 4):
        a, b, c = ([x for x in p if x[0] == s] for p in parts)
        rows = a + b if a and merge else a or b
        if rows:
            rows = greedy(sorted(((x[3], x[1], x[2], x[4]) for x in rows), reverse=True), 4.0)
        else:
            rows = [(x[3], x[1], x[2], x[4]) for x in c]
        assert sorted(x[:4] for x in got[s]) == sorted(rows)
        assert sorted(x[4] for x in got[s]) == list(range(1, len(rows) + 1))
    assert detection.dispatch(*frames).where("slice_id = 4").count() == 1 - 1  # a model was asked for, so no fallback
    with pytest.raises(ValueError):
        detection.dispatch(None, None, frames[2])


def test_intermediate_tables_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from stratiform import shared

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared.folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.folder(session("local[4]")).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.folder(session(master))


def test_run_control_and_report(spark):
    jobs = spark.createDataFrame([("a", "running"), ("b", "done")], "job_id string, status string")
    with pytest.raises(runs.RunError) as e:
        runs.start(jobs, "a")
    assert e.value.status == 409
    with pytest.raises(runs.RunError):
        runs.cancel(jobs, "nobody")
    assert {r.job_id: r.status for r in runs.cancel(runs.start(jobs, "b"), "a").collect()} == {"a": "cancelled", "b": "running"}
    pins = spark.createDataFrame([("x",)], "run_name string")
    assert {r.run_name for r in runs.pin(pins, "y").collect()} == {"x", "y"} and runs.pin(pins, "x", False).count() == 0


def test_family_colors_equal_colorsys(spark):
    import colorsys

    from stratiform.functions import text

    ids = list(range(1, 400))
    hexes = [f"{(i * 104729) % (1 << 24):06X}" for i in ids]
    df = spark.createDataFrame(list(zip(ids, hexes, strict=True)), "id int, hex string")
    for r in text.family_rgb(df, "id", "hex", "c").collect():
        h, light, s = colorsys.rgb_to_hls(*(int(r.hex[k : k + 2], 16) / 255.0 for k in (0, 2, 4)))
        light = min(0.78, max(0.28, light + ((r.id * 37) % 9 - 4) * 0.028))
        want = [int(v * 255 + 1e-9) for v in colorsys.hls_to_rgb(h, light, min(0.95, max(0.35, s * 1.08)))]
        assert all(abs(a - b) <= (1 if abs(b - a) else 0) for a, b in zip((r.c.r, r.c.g, r.c.b), want, strict=True))


def test_encoded_files_round_trip():
    r = np.random.default_rng(8)
    for dtype in ("uint8", "uint16"):
        a = r.integers(0, 200, (7, 5)).astype(dtype)
        assert (files.decode_tiff(files.encode_tiff(a))[0, :, :, 0] == a).all() and (files.decode_npy(files.encode_npy(a)) == a).all()


def lzw(data):
    """Plain TIFF LZW, codes one early, for the test alone."""
    bits, out, table, width = 0, [], {bytes([i]): i for i in range(256)}, 9
    codes, w, n = [(256, 9)], b"", 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        w = bytes([b])
        if n == 4094:
            codes.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    codes += [(table[w], width), (257, 9 if n + 1 < 512 else 10 if n + 1 < 1024 else 11 if n + 1 < 2048 else 12)]
    total = 0
    for c, k in codes:
        bits, total = (bits << k) | c, total + k
    pad = -total % 8
    out = (bits << pad).to_bytes((total + pad) // 8, "big")
    return out


def test_tiff_compressions():
    r = np.random.default_rng(2)
    for n in (1, 50, 3000, 20_000):
        data = bytes(r.integers(0, 6, n).astype(np.uint8))
        assert files._lzw(lzw(data)) == data, n
    assert files._pack_bits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])
    a = r.integers(0, 60_000, (33, 21)).astype("uint16")
    assert (files.decode_tiff(files.encode_tiff(a, deflate=True))[0, :, :, 0] == a).all()
    # two tiles of 16 x 16 with differences along rows
    import struct
    import zlib

    img = r.integers(0, 255, (16, 32)).astype("uint8")
    tiles = [zlib.compress(np.diff(img[:, k : k + 16].astype("uint8"), axis=1, prepend=np.zeros((16, 1), "uint8")).astype("uint8").tobytes()) for k in (0, 16)]
    tags = [(256, 4, [32]), (257, 4, [16]), (258, 3, [8]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 4, [16]), (323, 4, [16])]
    head = 8 + 2 + 12 * (len(tags) + 2) + 4
    first = head + 16
    places, sizes = [first, first + len(tiles[0])], [len(t) for t in tiles]
    ifd = struct.pack("<H", len(tags) + 2) + b"".join(struct.pack("<HHII", t, k, 1, v[0]) for t, k, v in tags)
    ifd += struct.pack("<HHII", 324, 4, 2, head) + struct.pack("<HHII", 325, 4, 2, head + 8) + struct.pack("<I", 0)
    raw = b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<4I", *places, *sizes) + b"".join(tiles)
    assert (files.decode_tiff(raw)[0, :, :, 0] == img).all()


def test_command_line(spark, tmp_path, capsys):
    from stratiform.__main__ import main

    assert main(["queries"]) == 0 and "g05_ontology_rollup" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"project": {"name": ""}}')
    assert main(["check", str(tmp_path / "c.json")]) == 1 and "project.name" in capsys.readouterr().out
    assert main(["query", "nothing", str(tmp_path)]) == 2


def test_area_of_a_square_by_triangles():
    pts = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [3, 4], [7, 2]], float)
    area = sum(abs(np.linalg.det(np.vstack([pts[list(t)].T, np.ones(3)]))) / 2 for t in landmarks.triangles(pts))
    assert abs(area - 100) < 1e-6
    assert len(list(combinations(range(3), 2))) == 3
