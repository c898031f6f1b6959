"""Least squares and elastic nets from additive sufficient statistics.

One Spark pass turns expanded events and samples into X'X, X'Y, Y'Y and counts for each fold; their
size depends on the model alone. Ordinary, ridge, minimum-norm and iterative solutions, elastic
net paths, partial models and cross-validation are then small problems for the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import intervals, lsmr, packed
from kernelweave.operators.design import Design
from kernelweave.operators.expand import known, missing


@dataclass
class Statistics:
    keys: list[tuple[int, int]]  # (col_id, basis_id) of each model column
    channels: list[int]
    folds: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # n, X'X, X'Y, sum y, sum y^2, sum x

    def total(self, without: int | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [s for f, s in self.folds.items() if f != without]
        return tuple(sum(p[i] for p in parts) for i in range(6)) if parts else self.empty()

    def empty(self):
        p, c = len(self.keys), len(self.channels)
        return 0, np.zeros((p, p)), np.zeros((p, c)), np.zeros(c), np.zeros(c), np.zeros(p)


#: Columns of a block of X'X: sums travel as blocks of so many columns squared, upper triangle only.
BLOCK = 256


def _cells(codes: np.ndarray, c: int):
    """For a tile: dense blocks of samples, their products added up, as packed blocks of the model's columns.

    Rows (fold, i, j, v): the block i, j of X'X; j = -1: the block i of X'Y, -2: its columns' sums; i = -1: n, sums and squares of y.
    """
    p = len(codes)

    def run(key, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        mine, place = np.unique(np.searchsorted(codes, xs["k"].to_numpy(np.int64)), return_inverse=True)
        q, out = len(mine), []
        block = max(64, min(4096, (1 << 23) // max(q, 1)))
        for fold, y in ys.groupby("fold"):
            t, inverse = np.unique(y["t"].to_numpy(), return_inverse=True)
            values = np.full((len(t), c), np.nan)
            values[inverse, y["c"].to_numpy()] = y["y"].to_numpy()
            n, gram, cross, total, squares, columns = 0, np.zeros((q, q)), np.zeros((q, c)), np.zeros(c), np.zeros(c), np.zeros(q)
            row = np.searchsorted(t, xs["t"].to_numpy())
            ok = (row < len(t)) & (t[np.minimum(row, len(t) - 1)] == xs["t"].to_numpy())
            order = np.argsort(row[ok], kind="stable")
            row, col, v = row[ok][order], place[ok][order], xs["v"].to_numpy()[ok][order]
            used = np.unique(row)  # samples without any event tell nothing
            if np.isnan(values[used]).any():
                raise ValueError(f"recording {key[0]}: modelled samples miss values in some channels; fill them, exclude their times or fit the channels apart")
            for lo in range(0, len(used), block):
                some = used[lo : lo + block]
                at, to = np.searchsorted(row, [some[0], some[-1] + 1])
                x = np.zeros((len(some), q))
                np.add.at(x, (np.searchsorted(some, row[at:to]), col[at:to]), v[at:to])
                yy = values[some]
                n, total, squares = n + len(some), total + yy.sum(0), squares + (yy * yy).sum(0)
                gram += x.T @ x
                cross += x.T @ yy
                columns += x.sum(0)
            out.append((fold, -1, -1, np.concatenate([[n], total, squares])))
            cuts = np.searchsorted(mine, np.arange(0, p + BLOCK, BLOCK))
            part = [(i, slice(a, b), mine[a:b] - i * BLOCK, min(BLOCK, p - i * BLOCK)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            for k, (i, here, rows, size) in enumerate(part):
                for what, a in ((-1, cross[here]), (-2, columns[here, None])):
                    whole = np.zeros((size, a.shape[1]))
                    whole[rows] = a
                    out.append((fold, i, what, whole))
                for j, there, cols, width in part[k:]:
                    whole = np.zeros((size, width))
                    whole[np.ix_(rows, cols)] = gram[here, there]
                    out.append((fold, i, j, whole))
        return pd.DataFrame([(f, i, j, w.tobytes()) for f, i, j, w in out], columns=["fold", "i", "j", "v"])

    return run


def statistics(xdc: DataFrame, samples: DataFrame, channels: list[int] | None = None, fold: str | None = None, tile: int = 16_384) -> Statistics:
    """From xdc(recording_id, t, col_id, basis_id, v) and samples(recording_id, t, channel, y [, fold]).

    Samples that no event reaches are left out; a modelled sample with a null y in some channel, or
    without its row, raises. Tiles of the time axis are the groups: a recording may be long, and a group
    never holds more than a tile. Sums are packed blocks, added up inside tasks and then by block.
    """
    if channels is not None:
        samples = samples.where(F.col("channel").isin(*channels))
    names = [r[0] for r in samples.select("channel").distinct().orderBy("channel").collect()]
    if not names:
        return Statistics([], names, {})
    channel = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    part = [F.col("recording_id").alias("rec"), F.floor(F.col("t") / tile).alias("tile")]
    xs = xdc.select(*part, "t", (F.shiftleft(F.col("col_id").cast("long"), 32) + F.col("basis_id") + 1).alias("k"), "v")
    # the model's columns, as many as it has
    codes = np.array(sorted(r[0] for r in xs.select("k").distinct().collect()), np.int64)
    out = Statistics([(int(k >> 32), int(k & 0xFFFFFFFF) - 1) for k in codes], names, {})
    if not len(codes):
        return out
    ys = samples.select(*part, "t", channel[F.col("channel")].alias("c"), "y", (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    cells = xs.groupBy("rec", "tile").cogroup(ys.groupBy("rec", "tile")).applyInPandas(_cells(codes, len(names)), "fold int, i int, j int, v binary")
    c, p = len(names), len(codes)
    for fold_, i, j, v in packed.summed(cells, "fold", "i", "j").collect():  # (p + channels + 1) x p numbers a fold at most
        n, gram, cross, total, squares, columns = out.folds.setdefault(int(fold_), out.empty())
        a = np.frombuffer(v)
        if i < 0:
            out.folds[int(fold_)] = (int(round(a[0])), gram, cross, total + a[1 : 1 + c], squares + a[1 + c :], columns)
            continue
        rows = slice(i * BLOCK, min(p, (i + 1) * BLOCK))
        if j < 0:
            (cross if j == -1 else columns[:, None])[rows] = a.reshape(-1, c if j == -1 else 1)
        else:
            cols = slice(j * BLOCK, min(p, (j + 1) * BLOCK))
            gram[rows, cols] = a.reshape(rows.stop - rows.start, -1)
            gram[cols, rows] = gram[rows, cols].T
    return out


def gram_by_join(xdc: DataFrame) -> DataFrame:
    """(col_a, basis_a, col_b, basis_b, g): X'X as a join on the sample, for any engine to check."""
    a = xdc.select("recording_id", "t", F.col("col_id").alias("col_a"), F.col("basis_id").alias("basis_a"), F.col("v").alias("va"))
    b = xdc.select("recording_id", "t", F.col("col_id").alias("col_b"), F.col("basis_id").alias("basis_b"), F.col("v").alias("vb"))
    return a.join(b, ["recording_id", "t"]).groupBy("col_a", "basis_a", "col_b", "basis_b").agg(F.sum(F.col("va") * F.col("vb")).alias("g"))


def solve(gram: np.ndarray, cross: np.ndarray, method: str = "normal", ridge: float = 0.0, iterations: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, int]:
    """(coefficients, iterations) after scaling columns to norm 1; columns of zeros get 0.

    normal: Cholesky, or the minimum norm where that fails; pinv: minimum norm; cg (lsmr and lsqr, where only
    products are at hand): conjugate gradients, which stop at a tolerance or after a number of steps.
    """
    norm = np.sqrt(np.diag(gram))
    use = norm > 0
    scale = np.where(use, norm, 1.0)
    a = gram / np.outer(scale, scale) + ridge * np.eye(len(gram))
    b = cross / scale[:, None]
    steps = 0
    if method in ("cg", "lsmr", "lsqr", "par-lsmr"):
        x, r = np.zeros_like(b), b.copy()
        d, rr = r.copy(), (r * r).sum(0)
        first = np.sqrt(rr)
        while steps < iterations and (np.sqrt(rr) > tol * np.maximum(first, 1e-300)).any():
            ad = a @ d
            step = rr / np.maximum((d * ad).sum(0), 1e-300)
            x, r = x + step * d, r - step * ad
            new = (r * r).sum(0)
            d, rr, steps = r + new / np.maximum(rr, 1e-300) * d, new, steps + 1
    elif method in ("normal", "matlab", "pinv"):
        x = None
        if method != "pinv":
            try:
                low = np.linalg.cholesky(a[np.ix_(use, use)])
                if low.diagonal().min() > 1e-7:
                    x = np.zeros_like(b)
                    x[use] = np.linalg.solve(low.T, np.linalg.solve(low, b[use]))
            except np.linalg.LinAlgError:
                pass
        if x is None:
            x = np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b
    else:
        raise ValueError(method)
    return x / scale[:, None], steps


def elastic_net(gram: np.ndarray, cross: np.ndarray, n: int, sum_x: np.ndarray | None = None, sum_y: float = 0.0, yy: float = 0.0, alpha: float = 1.0, lambdas: np.ndarray | None = None, n_lambda: int = 100, standardize: bool = True, intercept: bool = True, tol: float = 1e-7, penalty: np.ndarray | None = None, limits: tuple[float, float] = (-np.inf, np.inf)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lambdas, coefficients[lambda], intercepts): RSS / 2n + lambda ((1 - alpha) |b|^2 / 2 + alpha |b|), by covariance updates."""
    p = len(gram)
    mean = sum_x / n if intercept and sum_x is not None else np.zeros(p)
    my = sum_y / n if intercept else 0.0
    cov, xy = gram / n - np.outer(mean, mean), cross / n - mean * my
    sd = np.sqrt(np.maximum(np.diag(gram / n) - (sum_x / n if sum_x is not None else np.zeros(p)) ** 2, 0)) if standardize else np.ones(p)
    live = (sd > 0) & (np.diag(cov) > 0)
    sd = np.where(live, sd, 1.0)
    cov, xy = cov / np.outer(sd, sd), np.where(live, xy / sd, 0.0)
    weight = np.ones(p) if penalty is None else penalty * p / penalty.sum()
    if lambdas is None:
        top = np.abs(xy / np.where(weight > 0, weight, np.inf)).max() / max(alpha, 1e-3)
        lambdas = top * np.power(1e-4 if n >= p else 1e-2, np.arange(n_lambda) / max(n_lambda - 1, 1))
    var = np.diag(cov)
    b, out = np.zeros(p), []
    grad = xy.copy()  # xy - cov b
    scale = max(yy / n - my * my, 1e-300)
    for lam in lambdas:
        active = np.flatnonzero(live)
        while True:
            worst = 0.0
            for j in active.tolist():
                z = grad[j] + var[j] * b[j]
                new = np.sign(z) * max(abs(z) - lam * alpha * weight[j], 0.0) / (var[j] + lam * (1 - alpha) * weight[j])
                new = min(max(new, limits[0] * sd[j]), limits[1] * sd[j])
                if new != b[j]:
                    d = new - b[j]
                    grad -= cov[:, j] * d
                    worst = max(worst, var[j] * d * d)
                    b[j] = new
            if worst < tol * scale:
                full = np.flatnonzero(live)
                if len(active) == len(full):
                    break
                active = full
            else:
                nonzero = np.flatnonzero(live & (b != 0))
                active = nonzero if len(active) == p or len(active) > len(nonzero) and worst < tol * scale * 100 else np.flatnonzero(live)
        out.append(b / sd)
    coefs = np.array(out)
    return np.asarray(lambdas), coefs, my - coefs @ mean


def one_se(lambdas: np.ndarray, loss: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(lambda_min, lambda_1se, mean loss, its standard error) from losses[fold, lambda]."""
    w = weights / weights.sum()
    mean = w @ loss
    se = np.sqrt(w @ (loss - mean) ** 2 / (len(loss) - 1))
    best = int(mean.argmin())
    return float(lambdas[best]), float(lambdas[np.flatnonzero(mean <= mean[best] + se[best])].max()), mean, se


def cv_elastic_net(stats: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, float, float]], alpha: float = 1.0, **kw) -> dict:
    """From fold statistics (n, X'X, X'y, sum x, sum y, sum y^2): one shared path, at least 3 folds."""
    if len(stats) < 3:
        raise ValueError("at least 3 folds")
    whole = tuple(sum(s[i] for s in stats) for i in range(6))

    def fit(s, lambdas=None):
        return elastic_net(s[1], s[2], s[0], s[3], s[4], s[5], alpha=alpha, lambdas=lambdas, **kw)

    lambdas, coefs, icept = fit(whole)
    losses = []
    for s in stats:
        rest = tuple(a - b for a, b in zip(whole, s, strict=True))
        _, c, i = fit(rest, lambdas)
        rss = s[5] - 2 * (c @ s[2] + i * s[4]) + np.einsum("lp,pq,lq->l", c, s[1], c) + 2 * i * (c @ s[3]) + s[0] * i * i
        losses.append(rss / s[0])
    low, within, mean, se = one_se(lambdas, np.array(losses), np.array([s[0] for s in stats], float))
    at = int(np.flatnonzero(lambdas == within)[0])
    return {"lambdas": lambdas, "coefs": coefs, "intercepts": icept, "lambda_min": low, "lambda_1se": within, "cvm": mean, "cvse": se, "beta": coefs[at], "intercept": icept[at]}


def at_lambda(lambdas: np.ndarray, coefs: np.ndarray, wanted: float) -> np.ndarray:
    """Coefficients between two points of a path, linear in lambda; at its ends beyond them."""
    order = np.argsort(lambdas)
    return np.array([np.interp(wanted, lambdas[order], c[order]) for c in coefs.T])


def coefficients(spark, stats: Statistics, beta: np.ndarray, method: str) -> DataFrame:
    rows = [(int(ch), int(c), int(b), float(beta[i, k]), method) for i, (c, b) in enumerate(stats.keys) for k, ch in enumerate(stats.channels)]
    return spark.createDataFrame(rows, "channel int, col_id int, basis_id int, beta double, method string")


def beta_sets(**sets: DataFrame) -> DataFrame:
    """Several tables of coefficients as one, told apart by the column set; condense and predict keep it."""
    return reduce(DataFrame.unionByName, [c.withColumn("set", F.lit(name)) for name, c in sets.items()])


def fit_overlap(xdc: DataFrame, samples: DataFrame, method: str = "normal", channels: list[int] | None = None, **kw) -> DataFrame:
    """(channel, col_id, basis_id, beta, method): kernels of all columns at once, overlap corrected.

    lsmr, lsqr and par-lsmr work on the sparse rows, all channels in each pass (tol, iterations, damp, limit);
    the other methods on X'X. One that stops early warns.
    """
    if method in ("lsmr", "lsqr", "par-lsmr"):
        keys, names, found = lsmr.fit(xdc, samples, channels, **kw)
        if not found.converged:
            warnings.warn(f"{method} stopped after {found.steps} steps: {dict(zip(names, found.status, strict=True))}", stacklevel=2)
        return coefficients(xdc.sparkSession, Statistics(keys, names, {}), found.x, method)
    stats = statistics(xdc, samples, channels)
    if not stats.folds:
        return coefficients(xdc.sparkSession, Statistics([], [], {}), np.zeros((0, 0)), method)
    _, gram, cross, *_ = stats.total()
    beta, steps = solve(gram, cross, method, **kw)
    if steps and steps >= kw.get("iterations", 400):
        warnings.warn(f"{method} stopped after {steps} steps before it reached its tolerance", stacklevel=2)
    return coefficients(xdc.sparkSession, stats, beta, method)


def _products(p: int):
    """Rows of p numbers as the sum of their products, p x p, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "v"])

    return run


def fit_epochs(design: Design, samples: DataFrame, lo: int, width: int, method: str = "pinv", exclude: DataFrame | None = None) -> DataFrame:
    """(channel, col_id, lag, beta): one regression for each lag and channel, of the epochs of events on the design's columns.

    Events with a whole window, touching no interval of exclude, count. X'X comes from events once. Epochs are not cut: events of one
    sample share their window, so X'Y is a join of the columns' sums at each sample with the signal. Only columns x columns and
    columns x lags x channels numbers reach the driver.
    """
    kept = intervals.whole(design.events, samples, lo, width, exclude)
    mine, p = replace(design, events=kept), len(design.columns)
    keys = ["recording_id", "_lat"]
    types = sorted({t for c in design.columns for t in c.event_types})
    rows = kept.where(F.col("type").isin(*types)).select(F.array(*[F.when(F.col("type").isin(*c.event_types), F.coalesce(c.expr.cast("double"), missing())).otherwise(F.lit(0.0)) for c in design.columns]).alias("x"))
    g = np.frombuffer(packed.summed(rows.mapInArrow(_products(p), "key int, v binary"), "key").first()["v"]).reshape(p, p)
    at = mine.long().withColumn("_lat", F.round("latency").cast("long")).groupBy(*keys, "col_id").agg(F.sum(known("x")).alias("x")).where("x <> 0")
    at = at.select("recording_id", "col_id", "x", F.explode(F.sequence(F.lit(lo), F.lit(lo + width - 1))).alias("lag"), (F.col("_lat") + F.col("lag")).alias("t"))
    cross = at.join(samples.select("recording_id", "t", "channel", "y"), ["recording_id", "t"]).groupBy("channel", "lag", "col_id").agg(F.sum(F.col("x") * F.col("y")).alias("v")).toPandas()
    used = np.flatnonzero(g.diagonal() > 0)
    cols = [design.columns[i].col_id for i in used]
    c = cross.pivot(index="col_id", columns=["channel", "lag"], values="v").reindex(index=cols).fillna(0)
    beta = solve(g[np.ix_(used, used)], c.to_numpy(), method)[0]
    out = [(int(ch), int(col), int(lag), float(beta[i, k])) for k, (ch, lag) in enumerate(c.columns) for i, col in enumerate(cols)]
    return samples.sparkSession.createDataFrame(out, "channel int, col_id int, lag int, beta double")
