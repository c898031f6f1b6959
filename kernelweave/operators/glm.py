"""Elastic-net paths of generalised linear models, of several classes, several responses and survival times.

The rows are packed into blocks once (of squared errors with few columns, one triangle is all that is needed). All models that are open at a time, several lambdas of the path and the path of each
left-out fold, take each Newton step together: one job sums loss, gradient and the curvature of their active columns.
The driver solves the penalised quadratic problem of each (`penalized.py`) and checks the gradient of all columns,
which comes with the same sums; columns that break the optimality conditions join. Nothing of the rows reaches the driver.

The objective is (sum of w * negative log likelihood) / sum of w + lambda * sum of penalty factors * ((1 - alpha) / 2 |b|^2 + alpha |b|), with b for
columns scaled to variance 1 if standardize. Poisson rates, log odds, class scores and hazards are linear on the
scale of the link. Rows with nulls in any used column are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import packed, penalized
from kernelweave.operators.cox import RiskSets
from kernelweave.operators.fit import one_se

FAMILIES = ("gaussian", "binomial", "poisson", "multinomial", "mgaussian", "cox")
#: Bytes of curvature that the models of one step may send, and lambdas that a step takes at most.
STEP_BYTES, LAMBDAS = 1 << 26, 10


def terms(family: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the loss, its falling slope for each linear predictor, and the curvature (rows x predictors x predictors)."""
    if family in ("gaussian", "mgaussian"):
        r = y - eta
        return 0.5 * (r * r).sum(1), r, np.broadcast_to(np.eye(eta.shape[1]), (*eta.shape, eta.shape[1]))
    if family == "binomial":
        m = 1 / (1 + np.exp(-eta))
        return (np.logaddexp(0, eta) - y * eta)[:, 0], y - m, np.maximum(m * (1 - m), 1e-9)[:, :, None]
    if family == "poisson":
        m = np.exp(np.minimum(eta, 50.0))
        return (m - y * eta)[:, 0], y - m, np.maximum(m, 1e-12)[:, :, None]
    top = eta.max(1, keepdims=True)
    e = np.exp(eta - top)
    m = e / e.sum(1, keepdims=True)
    loss = y.sum(1) * (top[:, 0] + np.log(e.sum(1))) - (y * eta).sum(1)
    weight = y.sum(1)[:, None]
    return loss, y - weight * m, weight[:, :, None] * (m[:, :, None] * (np.eye(eta.shape[1]) - m[:, None, :]))


def saturated(family: str, y: np.ndarray) -> np.ndarray:
    """The least loss that any prediction of a row has."""
    safe = np.where(y > 0, y, 1.0)
    if family == "binomial":
        z = np.where(y < 1, 1 - y, 1.0)
        return (-y * np.log(safe) - (1 - y) * np.log(z))[:, 0]
    if family == "poisson":
        return (y - y * np.log(safe))[:, 0]
    return -(y * np.log(safe)).sum(1) if family == "multinomial" else np.zeros(len(y))


def measures(family: str, eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row deviance, squared error, absolute error and (classes) error."""
    loss = terms(family, eta, y)[0]
    wrong = np.zeros(len(y))
    if family == "multinomial":
        e = np.exp(eta - eta.max(1, keepdims=True))
        mean, wrong = e / e.sum(1, keepdims=True), 1.0 - y[np.arange(len(y)), eta.argmax(1)]
    elif family == "binomial":
        mean = 1 / (1 + np.exp(-eta))
        wrong = np.where(eta[:, 0] > 0, 1 - y[:, 0], y[:, 0])
    else:
        mean = np.exp(np.minimum(eta, 50.0)) if family == "poisson" else eta
    return np.column_stack([2 * (loss - saturated(family, y)), ((y - mean) ** 2).sum(1), np.abs(y - mean).sum(1), wrong])


LOSSES = ("deviance", "mse", "mae", "class_error")


@dataclass
class Model:
    """One point of one path: rows of a fold left out (none: -1), lambda, coefficients (1 + columns x predictors), columns in play."""

    fold: int
    lam: float
    b: np.ndarray
    play: np.ndarray
    sums: tuple | None = None
    steps: int = 0
    objective: float = np.inf
    before: np.ndarray | None = None
    done: bool = False


@dataclass
class Path:
    family: str
    columns: list[str]
    lambdas: np.ndarray
    coefs: np.ndarray  # lambdas x columns, x predictors where there are several
    intercepts: np.ndarray
    classes: list = field(default_factory=list)
    deviance: np.ndarray | None = None
    null_deviance: float = np.nan
    options: dict = field(default_factory=dict)
    touched: int = 0  # columns whose curvature was ever summed

    def at(self, lam: float) -> np.ndarray:
        """Intercept and coefficients, linear between two points of the path; at its ends beyond them."""
        order = np.argsort(self.lambdas)
        full = np.concatenate([self.intercepts[:, None], self.coefs], 1)[order]
        flat = full.reshape(len(full), -1)
        return np.array([np.interp(lam, self.lambdas[order], c) for c in flat.T]).reshape(full.shape[1:])

    def exact(self, df: DataFrame, lam: float) -> Path:
        """The path refitted with lam as one of its points."""
        return glm_path(df, **(self.options | {"lambdas": sorted({*self.lambdas.tolist(), lam}, reverse=True)}))

    def nonzero(self, lam: float) -> list[str]:
        b = self.at(lam)[1:].reshape(len(self.columns), -1)
        return [c for c, v in zip(self.columns, b, strict=True) if v.any()]

    def table(self) -> list[tuple[int, float, float]]:
        """For each lambda the columns that are not 0, the share of the null deviance that is explained, and lambda."""
        live = self.coefs.reshape(*self.coefs.shape[:2], -1).any(2).sum(1)
        share = 1 - self.deviance / self.null_deviance if self.null_deviance else np.zeros(len(live))
        return [(int(n), float(s), float(lam)) for n, s, lam in zip(live, share, self.lambdas, strict=True)]

    def predict(self, lam: float, kind: str = "link", offset: Column | None = None) -> Column:
        """link, response or class at a lambda, over the predictors; arrays for several classes or responses."""
        b = self.at(lam)
        one = [sum((F.col(c) * F.lit(float(v)) for c, v in zip(self.columns, col[1:], strict=True) if v), F.lit(float(col[0]))) for col in b.reshape(len(b), -1).T]
        one = one if offset is None else [e + offset for e in one]
        if self.family in ("multinomial", "mgaussian"):
            eta = F.array(*one)
            if kind == "link" or kind == "response" and self.family == "mgaussian":
                return eta
            if kind == "response":
                top = F.array_max(eta)
                return F.transform(eta, lambda x: F.exp(x - top) / F.aggregate(eta, F.lit(0.0), lambda s, z: s + F.exp(z - top)))
            if kind == "class" and self.family == "multinomial":
                return F.array(*map(F.lit, self.classes))[F.array_position(eta, F.array_max(eta)).cast("int") - 1]
            raise ValueError(kind)
        if kind == "link":
            return one[0]
        if kind == "response":
            return 1 / (1 + F.exp(-one[0])) if self.family == "binomial" else F.exp(F.least(one[0], F.lit(50.0))) if self.family in ("poisson", "cox") else one[0]
        if kind == "class" and self.family == "binomial":
            return (one[0] > 0).cast("int")
        raise ValueError(kind)


class Rows:
    """Blocks of rows of the families that are sums over rows, and one job for each question about many models."""

    def __init__(self, df: DataFrame, columns: list[str], ys: list[Column], family: str, weight: Column, offset: Column, fold: Column):
        self.family, self.p, self.k = family, len(columns), len(ys)
        self.width = {"x": self.p, "y": self.k, "wof": 3}
        groups = {"x": [F.col(c) for c in columns], "y": ys, "wof": [weight, offset, fold]}
        self.table = packed.stored(packed.blocks(df, groups), "rows")

    def start(self) -> dict[int, dict[str, np.ndarray]]:
        """Of each fold: sums of w, x, x^2, y, the saturated loss, and the number of rows."""
        p, k, family = self.p, self.k, self.family

        def of(b):
            for f in np.unique(b["wof"][:, 2]):
                at = b["wof"][:, 2] == f
                w, x, y = b["wof"][at, 0], b["x"][at], b["y"][at]
                yield int(f), np.concatenate([[w.sum()], w @ x, w @ (x * x), w @ y, [w @ saturated(family, y), float(at.sum())]])

        return {f: {"w": v[0], "x": v[1 : 1 + p], "xx": v[1 + p : 1 + 2 * p], "y": v[1 + 2 * p : 1 + 2 * p + k], "least": v[-2], "n": v[-1]} for f, v in packed.sums(self.table, self.width, of).items()}

    def steps(self, models: list[Model]) -> None:
        """Gives every model (loss, falling gradient of all columns, curvature of those in play), each divided by the weights."""
        family, k = self.family, self.k
        jobs = [(m.fold, m.b, m.play) for m in models]

        def of(b):
            x = np.column_stack([np.ones(len(b["x"])), b["x"]])
            w, off, fold = b["wof"].T
            eta = (x @ np.column_stack([j[1] for j in jobs])).reshape(len(x), len(jobs), k) + off[:, None, None]
            for i, (left, _, play) in enumerate(jobs):
                wi = np.where(fold == left, 0.0, w)
                loss, slope, curve = terms(family, eta[:, i], b["y"])
                xs = x[:, play]
                q = len(play)
                h = np.empty((q, k, q, k))
                for a in range(k):
                    for c in range(a, k):
                        same = family == "mgaussian" and c != a
                        h[:, a, :, c] = 0.0 if same else xs.T @ (xs * (wi * curve[:, a, c])[:, None])
                        h[:, c, :, a] = h[:, a, :, c].T
                yield i, np.concatenate([[wi.sum(), wi @ loss], (x.T @ (slope * wi[:, None])).ravel(), h.ravel()])

        got = packed.sums(self.table, self.width, of)
        for i, m in enumerate(models):
            v, size = got[i], (1 + self.p) * k
            m.sums = v[1] / v[0], v[2 : 2 + size].reshape(-1, k) / v[0], v[2 + size :].reshape(len(m.play) * k, len(m.play) * k) / v[0]

    def held_out(self, models: list[Model]) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """Of each model on the fold that it left out: weight, weighted sums of the measures and of their squares, rows."""
        family, k = self.family, self.k
        jobs = [(m.fold, m.b) for m in models]

        def of(b):
            x = np.column_stack([np.ones(len(b["x"])), b["x"]])
            w, off, fold = b["wof"].T
            for i, (left, coef) in enumerate(jobs):
                at = fold == left
                if at.any():
                    m = measures(family, x[at] @ coef + off[at, None], b["y"][at])
                    yield i, np.concatenate([[w[at].sum()], w[at] @ m, w[at] @ (m * m), [float(at.sum())]])

        got, none = packed.sums(self.table, self.width, of), np.zeros(10)
        return [((v := got.get(i, none))[0], v[1:5], v[5:9], v[9]) for i in range(len(jobs))]


class Factors:
    """The families of squared errors with few columns: one pass leaves of each fold the triangle R of a QR of (1, x, y - offset), each row times the
    root of its weight, and no rows are stored. A model's residuals are R times its coefficients, as exact as from rows; steps are the driver's alone.
    """

    #: Columns and responses at most, without and with folds: each task holds a triangle for each fold.
    MOST, MOST_FOLDED = 512, 64
    table = None

    def __init__(self, df: DataFrame, columns: list[str], ys: list[Column], family: str, weight: Column, offset: Column, fold: Column):
        self.family, self.p, self.k = family, len(columns), len(ys)
        cells = [weight, offset, fold, F.lit(1.0), *map(F.col, columns), *ys]
        self.flat = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cells)])
        p, m = self.p, 1 + self.p + self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, tri = {}, {}
            for a in _rows(batches):
                for f in np.unique(a[:, 2]):
                    at = a[a[:, 2] == f]
                    w, z = at[:, 0], at[:, 3:]
                    x, y = z[:, 1 : 1 + p], z[:, 1 + p :]
                    v = np.concatenate([[w.sum()], w @ x, w @ (x * x), w @ y, [float(len(at))]])
                    sums[f] = sums[f] + v if f in sums else v
                    z[:, 1 + p :] -= at[:, 1:2]
                    z *= np.sqrt(w)[:, None]
                    tri[f] = packed.triangle(np.concatenate([tri.get(f, np.zeros((0, m))), z]))
            yield from (pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([np.concatenate([v, tri[f].ravel()]).tobytes()], pa.binary())], ["fold", "v"]) for f, v in sums.items())

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.concatenate([a[: -m * m] + b[: -m * m], packed.stacked(a[-m * m :], b[-m * m :])])

        got = {r["fold"]: np.frombuffer(r["v"]) for r in packed.summed(self.flat.mapInArrow(run, "fold int, v binary"), "fold", add=both).collect()}
        self.sums, self.triangles = {f: v[: -m * m] for f, v in got.items()}, {f: v[-m * m :].reshape(m, m) for f, v in got.items()}

    def start(self) -> dict[int, dict[str, np.ndarray]]:
        p, k = self.p, self.k
        return {f: {"w": v[0], "x": v[1 : 1 + p], "xx": v[1 + p : 1 + 2 * p], "y": v[1 + 2 * p : 1 + 2 * p + k], "least": 0.0, "n": v[-1]} for f, v in self.sums.items()}

    def steps(self, models: list[Model]) -> None:
        k, cut = self.k, 1 + self.p
        for m in models:
            r = np.concatenate([t for f, t in self.triangles.items() if f != m.fold])
            w = sum(v[0] for f, v in self.sums.items() if f != m.fold)
            left, xs = r[:, cut:] - r[:, :cut] @ m.b, r[:, m.play]
            h = np.zeros((len(m.play), k, len(m.play), k))
            for a in range(k):
                h[:, a, :, a] = xs.T @ xs
            m.sums = 0.5 * (left * left).sum() / w, r[:, :cut].T @ left / w, h.reshape(len(m.play) * k, len(m.play) * k) / w

    def held_out(self, models: list[Model]) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """Errors' sizes are in no triangle: one more pass over the rows."""
        family, p, jobs = self.family, self.p, [(m.fold, m.b) for m in models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for a in _rows(batches):
                w, off, fold = a[:, :3].T
                for i, (left, coef) in enumerate(jobs):
                    at = fold == left
                    if at.any():
                        m = measures(family, a[at, 3 : 4 + p] @ coef + off[at, None], a[at, 4 + p :])
                        total[i] = total.get(i, 0.0) + np.concatenate([[w[at].sum()], w[at] @ m, w[at] @ (m * m), [float(at.sum())]])
            yield from (pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["key", "v"]) for i, v in total.items())

        got = {r["key"]: np.frombuffer(r["v"]) for r in packed.summed(self.flat.mapInArrow(run, "key int, v binary"), "key").collect()}
        return [((v := got.get(i, np.zeros(10)))[0], v[1:5], v[5:9], v[9]) for i in range(len(jobs))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])


def _folds(start: dict[int, dict], left: int) -> dict:
    """Sums over the folds but the one left out."""
    parts = [s for f, s in start.items() if f != left]
    return {n: sum(s[n] for s in parts) for n in parts[0]}


class Fitter:
    """Paths of all folds side by side."""

    def __init__(self, rows, family: str, p: int, k: int, start: dict, alpha: float, standardize: bool, intercept: bool, factor: np.ndarray, exclude: np.ndarray, limits: tuple, grouped: bool, tol: float, steps: int):
        self.rows, self.family, self.p, self.k, self.start = rows, family, p, k, start
        self.alpha, self.intercept, self.tol, self.max_steps = alpha, intercept and family != "cox", tol, steps
        self.grouped = family == "mgaussian" or family == "multinomial" and grouped
        self.limits, self.screen = limits, True
        factor = factor * p / factor.sum() if factor.sum() else factor
        self.l1, self.l2, self.live = {}, {}, ~exclude
        # each path scales columns by the rows that it sees
        for f in [-1, *(f for f in start if f >= 0)]:
            s = _folds(start, f)
            var = np.maximum(s["xx"] / s["w"] - (s["x"] / s["w"]) ** 2, 0.0)
            # columns without variance say nothing beside the intercept
            self.live = self.live & ((var > 1e-14 * np.maximum(s["xx"] / s["w"], 1e-300)) if self.intercept or family == "cox" else s["xx"] > 0)
            scale = np.where(var > 0, np.sqrt(var), 1.0) if standardize else np.ones(p)
            self.l1[f], self.l2[f] = factor * scale, factor * scale * scale
        self.touched: set[int] = set()

    def null(self, fold: int) -> np.ndarray:
        s, b = _folds(self.start, fold), np.zeros((1 + self.p, self.k))
        if self.intercept:
            m = s["y"] / s["w"]
            if self.family == "binomial":
                m = np.log(np.clip(m, 1e-9, None) / np.clip(1 - m, 1e-9, None))
            elif self.family == "poisson":
                m = np.log(np.clip(m, 1e-9, None))
            elif self.family == "multinomial":
                m = np.log(np.clip(m, 1e-9, None))
                m = m - m.mean()
            b[0] = m
        return b

    def slope(self, m: Model, lam: float) -> np.ndarray:
        """How far each column's slope reaches, in units of its lasso penalty; infinite without penalty."""
        l1 = self.l1[m.fold]
        g = m.sums[1][1:] - lam * (1 - self.alpha) * self.l2[m.fold][:, None] * m.b[1:]
        size = np.sqrt((g * g).sum(1)) if self.grouped else np.abs(g).max(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, np.where(l1 > 0, size / (max(self.alpha, 1e-3) * np.where(l1 > 0, l1, 1.0)), np.inf), 0.0)

    def penalty(self, m: Model) -> float:
        b = m.b
        size = np.sqrt((b[1:] ** 2).sum(1)) if self.grouped else np.abs(b[1:]).sum(1)
        return m.lam * ((1 - self.alpha) / 2 * (self.l2[m.fold] @ (b[1:] ** 2).sum(1)) + self.alpha * (self.l1[m.fold] @ size))

    def columns(self, which: np.ndarray) -> np.ndarray:
        """Rows of the coefficients: the intercept, if any, and the columns."""
        return np.concatenate([np.zeros(int(self.intercept), np.int64), np.flatnonzero(which) + 1])

    def proposed(self, m: Model) -> np.ndarray:
        _, grad, h = m.sums
        q, k = len(m.play), self.k
        l1, l2 = np.zeros(q), np.zeros(q)
        pen = m.play > 0
        l1[pen], l2[pen] = m.lam * self.alpha * self.l1[m.fold][m.play[pen] - 1], m.lam * (1 - self.alpha) * self.l2[m.fold][m.play[pen] - 1]
        low, high = np.full(q, -np.inf), np.full(q, np.inf)
        low[pen], high[pen] = self.limits[0], self.limits[1]
        b = m.b.copy()
        b[m.play] = penalized.quadratic(h, grad[m.play].ravel(), m.b[m.play].ravel(), l1, l2, k, self.grouped, low, high).reshape(q, k)
        return penalized.centred(b, self.l1[m.fold], self.l2[m.fold], self.alpha, m.lam) if self.family == "multinomial" and not self.grouped else b

    def step(self, models: list[Model]) -> None:
        """Takes one step of all open models."""
        for m in models:
            self.touched.update(m.play.tolist())
        self.rows.steps(models)
        for m in models:
            value = m.sums[0] + self.penalty(m)
            if m.before is not None and value > m.objective + 1e-10 * (1 + abs(m.objective)) and m.steps < self.max_steps:
                # too far: half the way back
                m.b, m.steps = (m.b + m.before) / 2, m.steps + 1
                continue
            new, h = self.proposed(m), np.diag(m.sums[2]).reshape(len(m.play), self.k)
            far = float((h * (new - m.b)[m.play] ** 2).max(initial=0.0))
            m.objective, m.before, m.steps = value, m.b, m.steps + 1
            breaks = (self.slope(m, m.lam) > m.lam * (1 + 1e-7) + 1e-12) & (m.lam < 1e300) & ~np.isin(np.arange(1, self.p + 1), m.play) & self.live
            if far <= self.tol and not breaks.any():
                m.b, m.done = new, True
            elif m.steps >= self.max_steps:
                m.done = True
                warnings.warn(f"lambda {m.lam:.4g}: stopped after {m.steps} steps", stacklevel=4)
            else:
                m.b = new
                m.play = self.columns(np.isin(np.arange(1, self.p + 1), m.play) | breaks)

    def paths(self, folds: list[int], lambdas: np.ndarray | None, n_lambda: int, lambda_min: float, dfmax: int, pmax: int) -> tuple[np.ndarray, dict[tuple[int, int], Model]]:
        """Lambdas, and the model at each (fold, index)."""
        free = self.live & (self.l1[-1] == 0)
        null = {f: Model(f, 1e300, self.null(f), self.columns(free)) for f in folds}
        # the model of the intercept alone, against which deviances count
        self.base = Model(-1, 1e300, self.null(-1), self.columns(np.zeros(self.p, bool))) if free.any() else null[-1]
        while open_ := [m for m in {id(m): m for m in (*null.values(), self.base)}.values() if not m.done]:
            self.step(open_)
        if lambdas is None:
            top = max(float(np.where(free, 0.0, self.slope(null[-1], 0.0)).max(initial=0.0)), 1e-12)
            lambdas = top * lambda_min ** (np.arange(n_lambda) / max(n_lambda - 1, 1))
        found: dict[tuple[int, int], Model] = {}
        last, lam_before, at, ever = dict(null), float(max(lambdas[0], 1e-300)), 0, np.zeros(self.p, bool)
        while at < len(lambdas):
            widest = max(len(m.play) for m in last.values()) + 8
            many = int(min(LAMBDAS, max(1, STEP_BYTES // (8 * len(folds) * (2 * widest * self.k) ** 2)), len(lambdas) - at))
            models = []
            for i in range(at, at + many):
                lam = float(lambdas[i])
                for f in folds:
                    prior = last[f]
                    # the strong rule where it says something, else half of lambda; what it misses joins later
                    bar = 2 * lam - lam_before if 2 * lam > lam_before else lam / 2
                    play = self.slope(prior, 0.0) >= bar if self.screen else self.live
                    models.append(Model(f, lam, prior.b.copy(), self.columns((play | prior.b[1:].any(1) | free) & self.live)))
                    found[f, i] = models[-1]
            while open_ := [m for m in models if not m.done]:
                self.step(open_)
            for f in folds:
                last[f] = found[f, at + many - 1]
            for i in range(at, at + many):
                ever |= found[folds[0], i].b[1:].any(1)
                if found[folds[0], i].b[1:].any(1).sum() > dfmax or ever.sum() > pmax:
                    return lambdas[:i], found
            lam_before, at = float(lambdas[at + many - 1]), at + many
        return lambdas, found


def _prepared(df: DataFrame, columns: list[str], y, family: str, weight: Column | None, offset: Column | None, fold: str | None, standardize_response: bool):
    """(rows, number of linear predictors, classes, scale of responses)."""
    if family not in FAMILIES:
        raise ValueError(family)
    ys = [y] if isinstance(y, str) else list(y)
    if len(ys) != {"cox": 2}.get(family, 1) and family not in ("mgaussian", "multinomial"):
        raise ValueError(f"{family} does not take {len(ys)} outcomes")
    df = df.dropna(subset=[*columns, *ys, *([fold] if fold else [])])
    weight, offset, of = (F.lit(1.0) if weight is None else weight), (F.lit(0.0) if offset is None else offset), (F.col(fold) if fold else F.lit(-2))
    classes, scale = [], np.ones(len(ys))
    if family == "cox":
        return RiskSets(df, columns, ys[0], ys[1], weight, offset, of), 1, classes, scale
    if family == "multinomial":
        if len(ys) == 1:
            classes = [r[0] for r in df.select(y).distinct().orderBy(y).limit(1001).collect()]
            if len(classes) > 1000:
                raise ValueError(f"{y} has over 1000 classes")
            targets = [(F.col(ys[0]) == c).cast("double") for c in classes]
        else:
            classes, targets = ys, [F.col(c) for c in ys]
    else:
        if family == "mgaussian" and standardize_response:
            got = df.agg(*[F.stddev_pop(c).alias(c) for c in ys]).first()
            scale = np.array([got[c] or 1.0 for c in ys])
        targets = [F.col(c) / F.lit(float(s)) for c, s in zip(ys, scale, strict=True)]
    few = 1 + len(columns) + len(targets) <= (Factors.MOST_FOLDED if fold else Factors.MOST)
    kind = Factors if family in ("gaussian", "mgaussian") and few else Rows
    return kind(df, columns, targets, family, weight, offset, of), len(targets), classes, scale


def _fit(df, columns, y, family, alpha, lambdas, weight, offset, fold, steps, tol, standardize, intercept, n_lambda, lambda_min, dfmax, pmax, exclude, penalty_factor, limits, mtype, standardize_response, screen):
    rows, k, classes, scale = _prepared(df, columns, y, family, weight, offset, fold, standardize_response)
    p = len(columns)
    try:
        start = rows.start()
        if not start or not _folds(start, -1)["w"]:
            raise ValueError("no rows")
        if k < 2 and family == "multinomial":
            raise ValueError("one class")
        if unknown := {*(exclude or ()), *(penalty_factor or {})} - set(columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if limits[0] > 0 or limits[1] < 0 or lambdas is not None and min(lambdas) < 0:
            raise ValueError("limits enclose 0, and lambdas are not negative")
        out = np.array([c in (exclude or ()) for c in columns], bool)
        factor = np.array([(penalty_factor or {}).get(c, 1.0) for c in columns], float)
        fitter = Fitter(rows, family, p, k, start, alpha, standardize, intercept, factor, out, limits, mtype == "grouped", tol, steps)
        fitter.screen = screen
        n = _folds(start, -1)["n"]
        lambda_min = (1e-2 if n < p else 1e-4) if lambda_min is None else lambda_min
        dfmax = p + 1 if dfmax is None else dfmax
        pmax = min(2 * dfmax + 20, p) if pmax is None else pmax
        lams = None if lambdas is None else np.array(sorted(lambdas, reverse=True), float)
        folds = [-1, *sorted(f for f in start if f != -2)]
        lams, found = fitter.paths(folds, lams, n_lambda, lambda_min, dfmax, pmax)
        scores = None
        if len(folds) > 1:
            models = [found[f, i] for f in folds[1:] for i in range(len(lams))]
            scores = folds[1:], _parted(rows.held_out(models), len(lams))
    finally:
        packed.dropped(*([rows.table] if rows.table is not None else []))
    b = np.array([found[-1, i].b for i in range(len(lams))]).reshape(len(lams), 1 + p, k) * scale[None, None, :]
    s = _folds(start, -1)
    deviance = np.array([2 * (found[-1, i].sums[0] * s["w"] - s["least"]) for i in range(len(lams))])
    one = k == 1
    path = Path(family, columns, lams, b[:, 1:, 0] if one else b[:, 1:], b[:, 0, 0] if one else b[:, 0], classes, deviance, 2 * (fitter.base.sums[0] * s["w"] - s["least"]), {}, len(fitter.touched - {0}))
    return path, scores, {f: {i: found[f, i].b * scale[None, :] for i in range(len(lams))} for f in folds[1:]}


def _parted(values: list, size: int) -> list[list]:
    return [values[i : i + size] for i in range(0, len(values), size)] if size else []


def glm_path(
    df: DataFrame, columns: list[str], y, family: str = "gaussian", alpha: float = 1.0, lambdas: list[float] | None = None, weight: Column | None = None, offset: Column | None = None,
    steps: int = 100, tol: float = 1e-14, standardize: bool = True, intercept: bool = True, n_lambda: int = 100, lambda_min: float | None = None, dfmax: int | None = None, pmax: int | None = None,
    exclude: list[str] | None = None, penalty_factor: dict[str, float] | None = None, limits: tuple[float, float] = (-np.inf, np.inf), mtype: str = "ungrouped", standardize_response: bool = False, screen: bool = True,
) -> Path:
    """The path of a family, largest lambda first; 0 is no penalty.

    y: one column; (time, status) for cox; the responses for mgaussian; for multinomial one column of classes, or one of proportions for
    each class. Without lambdas n_lambda points are laid from the largest lambda at which a column enters down to lambda_min times it.
    The path ends before a point with more than dfmax columns, or once over pmax columns have ever entered. screen=False takes all columns into play from the start.
    A multinomial model is given by the coefficients of least penalty among equal ones.
    """
    path, _, _ = _fit(df, columns, y, family, alpha, lambdas, weight, offset, None, steps, tol, standardize, intercept, n_lambda, lambda_min, dfmax, pmax, exclude, penalty_factor, limits, mtype, standardize_response, screen)
    names = ("columns", "y", "family", "alpha", "weight", "offset", "steps", "tol", "standardize", "intercept", "exclude", "penalty_factor", "limits", "mtype", "standardize_response")
    given = locals()
    path.options = {n: given[n] for n in names}
    return path


def losses(df: DataFrame, path: Path, lam: float, y: str, by: str | None = None) -> DataFrame:
    """(by, n, mse, mae, deviance [, class_error]) of a fit on rows, for one linear predictor."""
    m, t = path.predict(lam, "response"), F.col(y)
    if path.family == "binomial":
        m = F.least(F.greatest(m, F.lit(1e-12)), F.lit(1 - 1e-12))
        dev = -2 * (t * F.log(m) + (1 - t) * F.log(1 - m))
    elif path.family == "poisson":
        dev = 2 * (F.when(t > 0, t * F.log(t / m)).otherwise(0.0) - (t - m))
    elif path.family == "gaussian":
        dev = (t - m) * (t - m)
    else:
        raise ValueError(path.family)
    out = [F.count("*").alias("n"), F.avg((t - m) * (t - m)).alias("mse"), F.avg(F.abs(t - m)).alias("mae"), F.avg(dev).alias("deviance")]
    if path.family == "binomial":
        out.append(F.avg(((m > 0.5).cast("int") != t).cast("double")).alias("class_error"))
    return df.groupBy(by).agg(*out) if by else df.agg(*out)


def glm_cv(df: DataFrame, columns: list[str], y, fold: str, family: str = "gaussian", loss: str = "deviance", grouped: bool = True, **kw) -> dict:
    """The path on all rows and those without each fold, fitted side by side: lambda_min and lambda_1se by held-out loss. At least 3 folds.

    fold: whole numbers from 0. grouped: losses are means of folds; else of rows. cox takes the partial likelihood of all
    rows less that of the rows without the fold. `kept` tells the predictions of the models that did not see a row.
    """
    if loss not in LOSSES or family == "cox" and loss != "deviance":
        raise ValueError(loss)
    names = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().limit(1001).collect())
    if not 3 <= len(names) <= 1000 or min(names) < 0:
        raise ValueError("3 to 1000 folds, from 0")
    defaults = {"alpha": 1.0, "lambdas": None, "weight": None, "offset": None, "steps": 100, "tol": 1e-14, "standardize": True, "intercept": True, "n_lambda": 100, "lambda_min": None, "dfmax": None, "pmax": None, "exclude": None, "penalty_factor": None, "limits": (-np.inf, np.inf), "mtype": "ungrouped", "standardize_response": False, "screen": True}
    o = defaults | kw
    path, (folds, scores), models = _fit(df, columns, y, family, fold=fold, **o)
    which = LOSSES.index(loss)
    weights = np.array([s[0][0] for s in scores])
    raw = np.array([[s[1][which] / s[0] if s[0] else np.nan for s in row] for row in scores])
    if grouped or family == "cox":
        low, within, mean, se = one_se(path.lambdas, raw, weights)
    else:
        w, n = weights.sum(), sum(row[0][3] for row in scores)
        mean = sum(np.array([s[1][which] for s in row]) for row in scores) / w
        squares = sum(np.array([s[2][which] for s in row]) for row in scores) / w
        se = np.sqrt(np.maximum(squares - mean**2, 0) / (n - 1))
        best = int(mean.argmin())
        low, within = float(path.lambdas[best]), float(path.lambdas[np.flatnonzero(mean <= mean[best] + se[best])].max())
    live = [int(v.any(-1).sum()) if v.ndim > 1 else int((v != 0).sum()) for v in path.coefs]
    return {"path": path, "lambda_min": low, "lambda_1se": within, "cvm": mean, "cvse": se, "folds": folds, "by_fold": raw, "nonzero": live, "models": models}


def kept(cv: dict, fold: str, lam: float, kind: str = "link") -> Column:
    """Of each row the prediction at a lambda of the path by the model that did not see the row's fold."""
    path: Path = cv["path"]
    i, out = int(np.abs(path.lambdas - lam).argmin()), None
    for f in cv["folds"]:
        b = cv["models"][f][i]
        one = Path(path.family, path.columns, path.lambdas[i : i + 1], b[None, 1:, 0] if b.shape[1] == 1 else b[None, 1:], b[None, 0, 0] if b.shape[1] == 1 else b[None, 0], path.classes)
        got = one.predict(float(path.lambdas[i]), kind)
        out = F.when(F.col(fold) == f, got) if out is None else out.when(F.col(fold) == f, got)
    return out
