"""Free-form registration of images of different kinds (M28): cubic B-spline displacements that raise mutual information, from coarse to fine.

The field is a tensor product of cubic B-splines over a grid of control points; the joint histogram counts the fixed image in plain bins and the moving one under a cubic
Parzen window, so that mutual information has an analytic gradient in the control points. Each level of the pyramid climbs with a step that halves where the
value would fall, against a small bending term. An image pair is one task's work; pairs spread over the cluster. A flat image on either side gives no displacement.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .flow import _sampled, resized
from .kernels import _grid, _schema, _tall


def _cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, (4 - 6 * t**2 + 3 * t**3) / 6, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def _slope(t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    return np.sign(t) * np.where(a < 1, -2 * a + 1.5 * a**2, np.where(a < 2, -0.5 * (2 - a) ** 2, 0.0))


@lru_cache(maxsize=32)
def basis(n: int, spacing: float) -> np.ndarray:
    """Weights of the control points (columns) at each of n places; points lie every `spacing`, one beyond either end."""
    points = np.arange(int(np.ceil((n - 1) / spacing)) + 3) - 1
    return _cubic(np.arange(n)[:, None] / spacing - points[None])


def bins_of(a: np.ndarray, bins: int) -> tuple[np.ndarray, float]:
    """Values as places among the bins, two free at either end for the window, and bins per unit."""
    lo, hi = float(a.min()), float(a.max())
    k = (bins - 5) / (hi - lo) if hi > lo else 0.0
    return 2 + (a - lo) * k, k


class Information:
    """Mutual information of a fixed image with moving values, and its slope in each of these."""

    def __init__(self, fixed: np.ndarray, bins: int, low: float, scale: float):
        self.bins, self.low, self.scale = bins, low, scale
        self.row = np.clip(np.rint(bins_of(fixed, bins)[0]).astype(int), 0, bins - 1).ravel()

    def __call__(self, moving: np.ndarray) -> tuple[float, np.ndarray]:
        m = (2 + (moving.ravel() - self.low) * self.scale).clip(1.001, self.bins - 2.001)
        first = np.floor(m).astype(int) - 1
        joint = np.zeros(self.bins * self.bins)
        at = [first + i for i in range(4)]
        for k in at:
            joint += np.bincount(self.row * self.bins + k, _cubic(m - k), self.bins * self.bins)
        p = joint.reshape(self.bins, self.bins) / len(m)
        both = np.outer(p.sum(1), p.sum(0))
        ok = p > 1e-12
        value = float((p[ok] * np.log(p[ok] / both[ok])).sum())
        told = np.where(ok, np.log(np.where(ok, p, 1.0) / np.maximum(p.sum(0), 1e-12)[None]), 0.0)
        slope = sum(told[self.row, k] * _slope(m - k) for k in at) * self.scale / len(m)
        return value, slope.reshape(moving.shape)


def bending(c: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of squared second differences of the control points, and its slope."""
    total, grad = 0.0, np.zeros_like(c)
    for axis in (1, 2):
        d = np.diff(c, 2, axis)
        total += float((d * d).sum())
        pad = lambda before, after: np.pad(d, [(before, after) if i == axis else (0, 0) for i in range(3)])  # noqa: B023, E731
        grad += 2 * (pad(0, 2) - 2 * pad(1, 1) + pad(2, 0))
    return total, grad


def registered(fixed: np.ndarray, moving: np.ndarray, *, spacing: float = 12.0, bins: int = 32, levels: int = 3, rounds: int = 80, stiffness: float = 2e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The field (v, u) with moving at displaced places telling most of fixed, and the information before and after each level."""
    told: list[float] = []
    flow = np.zeros((2, *fixed.shape))
    if np.ptp(fixed) <= 0 or np.ptp(moving) <= 0:
        return flow[0], flow[1], told
    for level in reversed(range(levels)):
        shape = tuple(max(16, n >> level) for n in fixed.shape)
        f, m = resized(fixed.astype(float), shape), resized(moving.astype(float), shape)
        start = np.stack([resized(flow[i], shape) * shape[i] / fixed.shape[i] for i in (0, 1)])
        by, bx = basis(shape[0], spacing), basis(shape[1], spacing)
        control = np.zeros((2, by.shape[1], bx.shape[1]))
        grid = np.indices(shape).astype(float)
        gy, gx = np.gradient(m)
        _, scale = bins_of(m, bins)
        information = Information(f, bins, float(m.min()), scale)

        def look(c: np.ndarray):
            field = start + np.stack([by @ c[i] @ bx.T for i in (0, 1)])  # noqa: B023
            y, x = grid[0] + field[0], grid[1] + field[1]  # noqa: B023
            value, slope = information(_sampled(m, y, x))  # noqa: B023
            cost, back = bending(c)
            pull = np.stack([by.T @ (slope * _sampled(g, y, x)) @ bx for g in (gy, gx)])  # noqa: B023
            return value - stiffness * cost, pull - stiffness * back, field

        value, grad, field = look(control)
        told.append(value)
        step = 1.0  # pixels that the fastest control point moves
        for _ in range(rounds):
            most = np.abs(grad).max()
            if most <= 0 or step < 0.01:
                break
            new = control + step / most * grad
            found = look(new)
            if found[0] > value:
                control, (value, grad, field), step = new, found, min(step * 1.2, 2.0)
            else:
                step /= 2
        told.append(value)
        flow = np.stack([resized(field[i], fixed.shape) * fixed.shape[i] / shape[i] for i in (0, 1)])
    return flow[0], flow[1], told


def register(pairs: DataFrame, keys: list[str], **parameters) -> DataFrame:
    """keys, y, x, v, u: each pair's field. pairs of full images: y, x, fixed, moving."""

    def run(key, pdf):
        (f, y0, x0), (m, _, _) = _grid(pdf, "fixed"), _grid(pdf, "moving")
        v, u, _ = registered(f, m, **parameters)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return _tall(keys, key, y, x, v=v[y - y0, x - x0], u=u[y - y0, x - x0])

    return pairs.groupBy(*keys).applyInPandas(run, _schema(pairs, keys, "y int, x int, v double, u double"))
