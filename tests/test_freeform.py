"""Free-form registration: gradients by differences, a known bend, and images of another kind."""

import numpy as np

from stratiform.operators import filters, flow, freeform


def bent(shape=(72, 80), seed=3):
    """An image, the same bent and with other grey values, and the bend."""
    r = np.random.default_rng(seed)
    a = filters.gaussian(r.random(shape), 2.0)
    a = (a - a.min()) / np.ptp(a)
    y, x = np.indices(shape).astype(float)
    v, u = 2.5 * np.sin(2 * np.pi * x / 80) * np.cos(np.pi * y / 72), -2.0 * np.cos(2 * np.pi * y / 72)
    # moving at p + field is fixed at p: fetch fixed at the inverse, found by a few steps
    gy, gx = y.copy(), x.copy()
    for _ in range(30):
        gy, gx = y - flow._sampled(v, gy, gx), x - flow._sampled(u, gy, gx)
    return a, flow._sampled(a, gy, gx), v, u


def test_known_bend_is_recovered_within_half_a_pixel():
    a, b, v, u = bent()
    for moving in (b, 1 - b, np.sin(3 * b)):  # the same, turned, and another kind of image
        gv, gu, told = freeform.registered(a, 200 * moving)
        inner = (slice(8, -8), slice(8, -8))
        off = np.hypot(gv - v, gu - u)[inner]
        assert off.mean() < 0.5 and np.hypot(v, u)[inner].mean() > 1.5, off.mean()
        assert told[-1] > told[0]


def test_slopes_equal_differences():
    r = np.random.default_rng(1)
    f, m = r.random((12, 14)), r.random((12, 14))
    low, scale = float(m.min()) - 0.1, 20 / (np.ptp(m) + 0.2)
    info = freeform.Information(f, 25, low, scale)
    _, slope = info(m)
    for p in [(0, 0), (5, 7), (11, 13)]:
        for h in (1e-6,):
            up, down = m.copy(), m.copy()
            up[p] += h
            down[p] -= h
            assert abs((info(up)[0] - info(down)[0]) / (2 * h) - slope[p]) < 1e-5
    c = r.standard_normal((2, 5, 6))
    _, g = freeform.bending(c)
    up, down = c.copy(), c.copy()
    up[1, 2, 3] += 1e-5
    down[1, 2, 3] -= 1e-5
    assert abs((freeform.bending(up)[0] - freeform.bending(down)[0]) / 2e-5 - g[1, 2, 3]) < 1e-6


def test_weights_of_control_points_add_up_to_one():
    for n, spacing in ((16, 5.0), (40, 12.0), (9, 3.5)):
        assert np.allclose(freeform.basis(n, spacing).sum(1), 1.0)


def test_flat_images_stay(spark):
    px = spark.createDataFrame([(1, y, x, 5.0, float(x)) for y in range(20) for x in range(20)], "k int, y int, x int, fixed double, moving double")
    out = freeform.register(px, ["k"])
    assert out.count() == 400 and out.where("v <> 0 or u <> 0").count() == 0
