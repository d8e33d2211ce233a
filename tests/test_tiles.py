"""Tiled images against whole ones, and seam merges against plain layouts."""

import random

import numpy as np

from stratiform.operators import graph, kernels, tiles


def tall(spark, images, name="value"):
    rows = [(k, int(y), int(x), float(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a) if v]
    return spark.createDataFrame(rows, f"k int, y int, x int, {name} double").repartition(4)


def flood(a):
    """By pixel: the first pixel of its 4-connected part of equal values."""
    out = {}
    for start in zip(*np.nonzero(a), strict=True):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and q not in out and a[q] == a[y, x]:
                    out[q] = start
                    todo.append(q)
    return {(int(y), int(x)): (int(s[0]) << 31) + int(s[1]) for (y, x), s in out.items()}


def test_components_across_tiles_equal_flood_fill(spark):
    r = np.random.default_rng(4)
    snake = np.zeros((25, 31), int)
    snake[::4] = 1
    snake[2::8, 0] = snake[1::8, 0] = snake[3::8, 0] = 1
    snake[5::8, -1] = snake[6::8, -1] = snake[7::8, -1] = 1
    images = {1: (r.random((25, 31)) < 0.6).astype(int), 2: snake, 3: r.integers(0, 3, (20, 20)), 4: np.ones((9, 9), int)}
    for tile in (4, 7, 64):
        got = tiles.tiled_components(tall(spark, images), ["k"], "value", tile).collect()
        for k, a in images.items():
            assert {(p.y, p.x): p.component for p in got if p.k == k} == flood(a), (k, tile)
    empty = tall(spark, images).where("false")
    assert tiles.tiled_components(empty, ["k"]).count() == 0


def test_chains_of_links_end(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(1, order[i], order[i + 1]) for i in range(n - 1)] + [(2, 5, 6), (2, 6, 5), (2, 9, 9)], "k int, a long, b long")
    got = {(x.k, x.node): x.least for x in graph.least_members(links, ["k"]).collect()}
    assert got == {**{(1, i): 0 for i in range(1, n)}, (2, 6): 5}


def test_blobs_are_the_same_for_any_tile(spark):
    r = np.random.default_rng(2)
    y, x = np.indices((70, 90))
    images = {}
    for k in (1, 2):
        a = r.random((70, 90)) * 0.1
        for _ in range(12):
            cy, cx, s = r.uniform(0, 70), r.uniform(0, 90), r.uniform(1.2, 4)
            a += np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
        images[k] = a
    px = tall(spark, images)
    key = lambda df: sorted(tuple(p) for p in df.collect())
    want = key(kernels.log_blobs(px, ["k"], high=3.0, steps=4))
    assert len(want) > 20
    for tile in (16, 33, 500):
        assert key(tiles.tiled_blobs(px, ["k"], high=3.0, steps=4, tile=tile)) == want, tile
    sparse = px.where("(y * 7 + x) % 5 <> 0")
    assert key(tiles.tiled_blobs(sparse, ["k"], high=2.0, steps=3, tile=20)) == key(kernels.log_blobs(sparse, ["k"], high=2.0, steps=3))


def test_no_cell_is_doubled_at_a_seam(spark):
    r = random.Random(8)
    tile, overlap = 32, 12
    rows, want = [], {}
    for layout in range(1000):
        size, span = 50, tile - overlap
        starts = list(range(0, size - overlap, span))
        free = []
        for c in range(r.randint(1, 4)):
            h, w = r.randint(2, overlap), r.randint(2, overlap)
            y, x = r.randint(0, size - h), r.randint(0, size - w)
            if any(y <= b[1] and b[0] <= y + h and x <= b[3] and b[2] <= x + w for b in free):
                continue
            free.append((y, y + h, x, x + w))
            want[layout] = want.get(layout, []) + [h * w]
            for ty, top in enumerate(starts):
                for tx, left in enumerate(starts):
                    rows += [(layout, 10 * ty + tx, c, q, p) for q in range(max(y, top), min(y + h, top + tile)) for p in range(max(x, left), min(x + w, left + tile))]
    got = {}
    for p in tiles.one_of_each_cell(spark.createDataFrame(rows, "k int, tile int, cell int, y int, x int"), ["k"]).collect():
        got.setdefault(p.k, []).append(p.area)
    doubled = [k for k in want if sorted(got[k]) != sorted(want[k])]
    assert not doubled, (len(doubled), doubled[0], got[doubled[0]], want[doubled[0]])
