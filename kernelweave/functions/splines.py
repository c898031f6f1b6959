"""Spline bases as Column expressions: piecewise cubics with literal coefficients, inside codegen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kernelweave.functions.sql import custom_basis
from kernelweave.plans.formula import Spline


def cubic_values(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-splines over knots with both ends repeated (len(knots) + 2 columns); the right end belongs to the last."""
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3]).astype(float)
    x = np.asarray(x, float)[:, None]
    inside = (t[:-1] <= x) & (x < t[1:])
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    inside[:, last] |= x[:, 0] == t[-1]
    b = inside.astype(float)
    for k in range(1, 4):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        a = np.where(left > 0, (x - t[: -k - 1]) / np.where(left > 0, left, 1), 0)
        c = np.where(right > 0, (t[k + 1 :] - x) / np.where(right > 0, right, 1), 0)
        b = a * b[:, :-1] + c * b[:, 1:]
    return np.where(np.isnan(x), np.nan, b)


def circular_values(x: np.ndarray, knots: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
    """Periodic cubic regression splines: one column for each knot but the last, which is the first again."""
    lo, hi = bounds
    n = len(knots) - 1
    h = np.diff(knots)
    # second derivatives from values, for a periodic natural cubic
    left, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        before, after = (i - 1) % n, (i + 1) % n
        left[i, before] += h[before] / 6
        left[i, i] += (h[before] + h[i]) / 3
        left[i, after] += h[i] / 6
        right[i, before] += 1 / h[before]
        right[i, i] -= 1 / h[before] + 1 / h[i]
        right[i, after] += 1 / h[i]
    second = np.linalg.solve(left, right)
    x = lo + np.mod(np.asarray(x, float) - lo, hi - lo)
    j = np.clip(np.searchsorted(knots, x, "right") - 1, 0, n - 1)
    j = np.where(np.isnan(x), 0, j)
    after = (j + 1) % n
    u, v, w = knots[j + 1] - x, x - knots[j], h[j]
    eye = np.eye(n)
    return (u / w)[:, None] * eye[j] + (v / w)[:, None] * eye[after] + ((u**3 / w - w * u) / 6)[:, None] * second[j] + ((v**3 / w - w * v) / 6)[:, None] * second[after]


def knot_count(kind: str, n: int) -> int:
    if n < 3:
        raise ValueError("a spline needs at least 3 functions")
    return n + 1 if kind == "circular" else max(n - 2, 2)


def pieces(kind: str, knots: np.ndarray, bounds: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(edges, coefficients[interval, function, power]): the basis as cubics in x - left edge."""
    edges = np.unique(knots)
    values = (lambda x: circular_values(x, knots, bounds)) if kind == "circular" else (lambda x: cubic_values(x, knots))
    at = np.array([0.0, 0.25, 0.5, 0.75])
    power = np.linalg.inv(np.vander(at, 4, increasing=True))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        c = power @ values(a + at * (b - a))  # in units of the interval
        out.append((c / (b - a) ** np.arange(4)[:, None]).T)
    return edges, np.array(out)


def columns(x: Column, kind: str, knots: np.ndarray, bounds: tuple[float, float] | None = None) -> list[Column]:
    """One Column for each basis function; null where x is null, 0 outside of the knots."""
    edges, coefs = pieces(kind, knots, bounds)
    if kind == "circular":
        lo, hi = bounds
        x = F.lit(lo) + F.pmod(x - F.lit(lo), F.lit(hi - lo))
    out = []
    for f in range(coefs.shape[1]):
        expr = F.lit(0.0)
        for i in range(len(edges) - 2, -1, -1):
            d = x - F.lit(float(edges[i]))
            cubic = F.lit(float(coefs[i, f, 3]))
            for p in (2, 1, 0):
                cubic = cubic * d + F.lit(float(coefs[i, f, p]))
            inside = (x >= float(edges[i])) & (x <= float(edges[i + 1]) if i == len(edges) - 2 else x < float(edges[i + 1]))
            expr = F.when(inside, cubic).otherwise(expr)
        out.append(F.when(x.isNotNull(), expr))
    return out


def basis(spline: Spline, knots: list[np.ndarray]) -> list[Column]:
    if spline.function:
        every = custom_basis(F.col(spline.variables[0]).cast("double"), spline.function, knots[0].tolist())
        return [every[i] for i in range(evaluate(spline, knots, knots[0]).shape[1])]
    if spline.kind != "2d":
        return columns(F.col(spline.variables[0]).cast("double"), spline.kind, knots[0], spline.bounds)
    first, second = (columns(F.col(v).cast("double"), "default", k) for v, k in zip(spline.variables, knots, strict=True))
    return [a * b for b in second for a in first]  # the first variable runs fastest


def evaluate(spline: Spline, knots: list[np.ndarray], *x: np.ndarray) -> np.ndarray:
    """The basis at values, for tests and prediction grids."""
    if spline.function:
        return np.asarray(spline.function(np.asarray(x[0], float), knots[0]), float)
    if spline.kind == "circular":
        return circular_values(x[0], knots[0], spline.bounds)
    if spline.kind == "default":
        return cubic_values(x[0], knots[0])
    a, b = cubic_values(x[0], knots[0]), cubic_values(x[1], knots[1])
    return (b[:, :, None] * a[:, None, :]).reshape(len(a), -1)
