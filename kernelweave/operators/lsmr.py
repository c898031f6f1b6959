"""Least squares on the sparse rows themselves (LSMR, Fong and Saunders 2011), for models whose X'X is too large or too ill-conditioned.

Golub-Kahan vectors on the side of the samples are never stored: each is gamma (y - X x0) + X w, with a
number gamma and a w of the model's size. So a step is one pass over the rows without any state, which
an executor can repeat, and only vectors of the model's size travel. All channels take their steps in the
same pass. Where gamma gets so large that the form loses digits, a channel starts again from what it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a partial sum that travel in one row.
CHUNK = 1024
#: A left vector's gamma, times the length of y - X x0, at which a channel starts again.
LOST = 1e6


class Operator(Protocol):
    """X and y behind one function; any object of this shape can be solved."""

    columns: int
    channels: int
    size: float  # a norm of X
    y_norm: np.ndarray

    def step(self, gamma: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(|u|^2, X'u, |y - X x|^2) by channel, u = gamma y + X w; w and x are columns x channels."""


class Dense:
    """Arrays, for small problems and tests."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        self.columns, self.channels, self.size, self.y_norm = x.shape[1], y.shape[1], float(np.linalg.norm(x)), np.linalg.norm(y, axis=0)

    def step(self, gamma, w, x):
        u, r = gamma * self.y + self.x @ w, self.y - self.x @ x
        return (u * u).sum(0), self.x.T @ u, (r * r).sum(0)


def _pass(gamma: np.ndarray, w: np.ndarray, x: np.ndarray):
    p, c = w.shape
    both = np.concatenate([w, x], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 2, c))
        for batch in batches:
            if not len(batch):
                continue
            cols, vals, ys = (batch.column(i) for i in range(3))
            k, v = cols.flatten().to_numpy(), vals.flatten().to_numpy()
            y = ys.flatten().to_numpy().reshape(len(batch), c)
            n = cols.value_lengths().to_numpy()
            at = np.repeat(np.arange(len(batch)), n)
            product = np.add.reduceat(both[k] * v[:, None], np.cumsum(n) - n, axis=0)
            u, r = gamma * y + product[:, :c], y - product[:, c:]
            for j in range(c):
                total[:p, j] += np.bincount(k, v * u[at, j], p)
            total[p] += (u * u).sum(0)
            total[p + 1] += (r * r).sum(0)
        flat = total.ravel()
        parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["part", "v"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = table.column("v").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(table), -1).sum(0)
    return pa.table({"part": table.column("part").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})


class Rows:
    """xdc(recording_id, t, col_id, basis_id, v) and samples as one kept row for each modelled sample; columns have norm 1."""

    def __init__(self, xdc: DataFrame, samples: DataFrame, channels: list[int] | None = None) -> None:
        if channels is not None:
            samples = samples.where(F.col("channel").isin(*channels))
        self.names = [r[0] for r in samples.select("channel").distinct().orderBy("channel").collect()]
        norms = xdc.groupBy("col_id", "basis_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).orderBy("col_id", "basis_id").collect()  # of the model's size
        self.keys = [(r[0], r[1]) for r in norms]
        self.scale = np.array([r[2] or 1.0 for r in norms], float)
        self.columns, self.channels, self.size = len(self.keys), len(self.names), float(np.sqrt(max(len(self.keys), 1)))
        spark = xdc.sparkSession
        number = spark.createDataFrame([(*k, i, float(s)) for i, (k, s) in enumerate(zip(self.keys, self.scale, strict=True))], "col_id int, basis_id int, k int, norm double")
        x = xdc.join(F.broadcast(number), ["col_id", "basis_id"]).groupBy("recording_id", "t").agg(F.collect_list(F.struct("k", (F.col("v") / F.col("norm")).alias("v"))).alias("x"))
        values = samples.groupBy("recording_id", "t").agg(F.array_sort(F.collect_list(F.struct("channel", "y"))).alias("y"))
        whole = (F.size("y") == self.channels) & ~F.exists(F.col("y.y"), lambda a: a.isNull())
        lost = F.raise_error(F.lit("modelled samples miss values in some channels; fill them, exclude their times or fit the channels apart"))
        y = F.when(whole, F.col("y.y")).otherwise(lost.cast("array<double>"))
        self.rows = x.join(values, ["recording_id", "t"]).select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), y.alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
        zero = np.zeros((self.columns, self.channels))
        self.y_norm = np.sqrt(self.step(np.ones(self.channels), zero, zero)[0]) if self.keys and self.names else np.zeros(self.channels)

    def step(self, gamma, w, x):
        sums = self.rows.mapInArrow(_pass(gamma, w, x), "part int, v array<double>").groupBy("part").applyInArrow(_summed, "part int, v array<double>")
        parts = sorted(sums.collect(), key=lambda r: r["part"])  # (columns + 2) x channels numbers
        total = np.concatenate([np.array(r["v"]) for r in parts]).reshape(self.columns + 2, self.channels) if parts else np.zeros((self.columns + 2, self.channels))
        return total[-2], total[:-2], total[-1]

    def close(self) -> None:
        self.rows.unpersist()


@dataclass
class Solution:
    """status of each channel: zero (y is, or is at right angles to X), residual (y is met), least squares
    (X'r is small), condition, precision (starting again no longer helps) or steps (the limit was reached)."""

    x: np.ndarray
    status: list[str]
    steps: int
    residual: np.ndarray
    condition: np.ndarray

    @property
    def converged(self) -> bool:
        return not {"steps", "condition"} & set(self.status)


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) != 0)


def lsmr(op: Operator, damp: float = 0.0, atol: float = 1e-8, btol: float = 1e-8, limit: float = 1e8, iterations: int = 400) -> Solution:
    """min |y - X x|^2 + damp^2 |x|^2 for every channel at once."""
    p, c = op.columns, op.channels
    base, x, v, w, h, hbar = (np.zeros((p, c)) for _ in range(6))
    begin, live = np.ones(c, bool), np.ones(c, bool)
    alpha, gamma, abar, zeta_bar = (np.zeros(c) for _ in range(4))
    turns, extent = np.zeros(c, int), np.array([np.full(c, np.inf), np.zeros(c)])  # rotations since the last begin; least and largest diagonal entry of the triangle
    rho, rho_bar, cos_bar, sin_bar = np.ones(c), np.ones(c), np.ones(c), np.zeros(c)
    start, before, residual = op.y_norm.copy(), np.full(c, np.inf), op.y_norm.copy()
    condition, status = np.ones(c), ["steps"] * c
    steps = 0

    def stop(which: np.ndarray, why: str) -> None:
        for j in np.flatnonzero(which & live):
            status[j], live[j] = why, False

    stop(op.y_norm == 0, "zero")
    while live.any():
        g = np.where(live, np.where(begin, 1.0, -alpha * gamma), 0.0)
        u = np.where(live, np.where(begin, 0.0, v - alpha * w), 0.0)
        square, back, rest = op.step(g, u - g * base, base + x)
        steps += 1
        beta = np.sqrt(square)
        residual = np.where(live, np.sqrt(rest), residual)
        back = _ratio(back, beta)
        normal = np.where(begin, np.linalg.norm(back, axis=0) * beta, np.abs(zeta_bar))
        stop(begin & (normal == 0) & (base == 0).all(0), "zero")
        stop(residual <= btol * op.y_norm + atol * op.size * np.linalg.norm(base + x, axis=0), "residual")
        stop(normal <= atol * op.size * residual, "least squares")
        stop(condition >= limit, "condition")
        stop(begin & (residual > before / 2), "precision")
        if steps > iterations or not live.any():
            break
        gamma, w = _ratio(g, beta), _ratio(u, beta)
        back = back - np.where(begin, 0.0, beta * v)
        alpha = np.linalg.norm(back, axis=0)
        v = _ratio(back, alpha)
        # channels at their first vector
        first = begin & live
        start, before = np.where(first, beta, start), np.where(first, residual, before)
        abar, zeta_bar = np.where(first, alpha, abar), np.where(first, alpha * beta, zeta_bar)
        rho, rho_bar, cos_bar, sin_bar = np.where(first, 1.0, rho), np.where(first, 1.0, rho_bar), np.where(first, 1.0, cos_bar), np.where(first, 0.0, sin_bar)
        h, hbar = np.where(first, v, h), np.where(first, 0.0, hbar)
        turns, extent = np.where(first, 0, turns), np.where(first, [[np.inf], [0.0]], extent)
        begin[:] = False
        # the others turn their new column of the bidiagonal into two rotations
        go = live & ~first
        ahat = np.hypot(abar, damp)
        rho_old, rho_bar_old = rho, rho_bar
        rho_new = np.hypot(ahat, beta)
        theta = _ratio(beta, rho_new) * alpha
        corner = cos_bar * rho_new
        bar_new = np.hypot(corner, theta)
        zeta = _ratio(corner, bar_new) * zeta_bar
        keep = h - _ratio(sin_bar * rho_new * rho_new, rho_old * rho_bar_old) * hbar
        hbar = np.where(go, keep, hbar)
        x = np.where(go, x + _ratio(zeta, rho_new * bar_new) * hbar, x)
        h = np.where(go, v - _ratio(theta, rho_new) * h, h)
        abar = np.where(go, _ratio(ahat, rho_new) * alpha, abar)
        zeta_bar = np.where(go, -_ratio(theta, bar_new) * zeta_bar, zeta_bar)
        cos_bar, sin_bar = np.where(go, _ratio(corner, bar_new), cos_bar), np.where(go, _ratio(theta, bar_new), sin_bar)
        # a turn closes the entry before it, and its own corner is open still; from their extent follows the condition number
        extent[0] = np.where(go & (turns > 0), np.minimum(extent[0], rho_bar_old), extent[0])
        extent[1] = np.where(go & (turns > 0), np.maximum(extent[1], rho_bar_old), extent[1])
        wide = _ratio(np.maximum(extent[1], corner), np.minimum(extent[0], np.maximum(corner, 1e-300)))
        condition, turns = np.where(go & (turns > 0), np.maximum(condition, wide), condition), turns + go
        rho, rho_bar = np.where(go, rho_new, rho), np.where(go, bar_new, rho_bar)
        if damp == 0:
            again = live & (np.abs(gamma) * start > LOST)
            base, x = np.where(again, base + x, base), np.where(again, 0.0, x)
            begin |= again
    return Solution(base + x, status, steps, residual, condition)


def fit(xdc: DataFrame, samples: DataFrame, channels: list[int] | None = None, damp: float = 0.0, tol: float = 1e-8, iterations: int = 400, limit: float = 1e8) -> tuple[list[tuple[int, int]], list[int], Solution]:
    """(model columns, channels, solution): damp weighs columns of norm 1; coefficients are of the columns as they are."""
    op = Rows(xdc, samples, channels)
    try:
        out = lsmr(op, damp, tol, tol, limit, iterations)
    finally:
        op.close()
    out.x = out.x / op.scale[:, None]
    return op.keys, op.names, out
