"""From coefficients to curves: condensing, prediction, marginals, model fit, single trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.functions import splines as sp
from kernelweave.functions.stats import hazen
from kernelweave.operators.design import Design
from kernelweave.operators.expand import basis_table
from kernelweave.operators.fit import Statistics, solve


def _set(df: DataFrame) -> list[str]:
    return ["set"] if "set" in df.columns else []


def condense(coefs: DataFrame, basis: np.ndarray, lo: int, srate: float, mass_univariate: bool = False) -> DataFrame:
    """(channel, col_id, lag, time_s, beta): coefficients of a time basis turned into curves."""
    b = basis_table(coefs.sparkSession, np.linalg.pinv(basis).T if mass_univariate else basis)
    out = coefs.join(F.broadcast(b), coefs["basis_id"] == b["function"]).groupBy("channel", "col_id", *_set(coefs), F.col("lag").alias("_l")).agg(F.sum(F.col("beta") * F.col("w")).alias("beta"))
    return out.select("channel", "col_id", *_set(coefs), (F.col("_l") + lo).alias("lag"), ((F.col("_l") + lo) / F.lit(float(srate))).alias("time_s"), "beta")


def grid(design: Design, at: dict[str, list[float]] | None = None, method: str = "quantile", n: int = 10) -> list[tuple[int, str, str, list[str], float | None, float | None, float]]:
    """Weights of columns at values of each variable: (col_id, variable, kind, event types, value, value2, weight)."""
    at = at or {}
    rows = []
    for c in design.columns:
        if c.kind in ("intercept", "categorical", "interaction", "trf"):
            rows.append((c.col_id, c.name, c.kind, list(c.event_types), None, None, 1.0))
        elif c.kind == "continuous":
            rows += [(c.col_id, c.name, c.kind, list(c.event_types), float(v), None, float(v)) for v in at.get(c.variable) or _auto(design, c.variable, c.event_types, method, n)]
    for name, fit in design.splines.items():
        cols = [c for c in design.columns if c.variable == name and c.kind == "spline"]
        values = [np.array(at.get(v) or at.get(name) or _auto(design, v, cols[0].event_types, method, n), float) for v in fit.spec.variables]
        if len(values) == 2:
            a, b = np.tile(values[0], len(values[1])), np.repeat(values[1], len(values[0]))
            values = [a, b]
        weights = np.delete(sp.evaluate(fit.spec, fit.knots, *values), fit.dropped, 1)
        for i, v in enumerate(values[0]):
            second = float(values[1][i]) if len(values) == 2 else None
            rows += [(c.col_id, name, "spline", list(c.event_types), float(v), second, float(weights[i, k])) for k, c in enumerate(cols)]
    return rows


def _auto(design: Design, variable: str, types: tuple[str, ...], method: str, n: int) -> list[float]:
    bare = variable if variable in design.events.columns else variable.split("_", 1)[-1]
    x = design.events.where(F.col("type").isin(*types)).select(F.col(bare).cast("double").alias("x"))
    if method == "average":
        return [x.agg(F.avg("x")).first()[0]]
    if method == "linear":
        lo, hi = x.agg(F.min("x"), F.max("x")).first()
        return np.linspace(lo + 0.05 * (hi - lo), hi - 0.05 * (hi - lo), n).tolist()
    ps = np.linspace(1 / (n + 1), n / (n + 1), n).tolist()
    return [r["q"] for r in hazen(x, "x", ps).orderBy("p").collect()]


def predict(curves: DataFrame, design: Design, at: dict[str, list[float]] | None = None, method: str = "quantile", n: int = 10) -> DataFrame:
    """(channel, variable, kind, event_types, value, value2, lag, time_s, beta) at values of continuous variables and splines."""
    rows = grid(design, at, method, n)
    g = curves.sparkSession.createDataFrame(rows, "col_id int, variable string, kind string, event_types array<string>, value double, value2 double, weight double")
    out = curves.join(F.broadcast(g), "col_id").groupBy("channel", *_set(curves), "variable", "kind", "event_types", "value", "value2", "lag", "time_s")
    return out.agg(F.sum(F.col("beta") * F.col("weight")).alias("beta"))


def marginal(predicted: DataFrame, curves: DataFrame, design: Design, kind: str = "MEM") -> DataFrame:
    """Adds to each parameter the other non-categorical ones of its event set.

    MEM: at their mean; AME: their basis averaged over the events. Sets are equal as sets.
    """
    if kind not in ("MEM", "AME"):
        raise ValueError(kind)
    rows = []
    for c in design.columns:
        events = design.events.where(F.col("type").isin(*c.event_types))
        if c.kind == "intercept":
            rows.append((c.col_id, c.name, list(c.event_types), 1.0))
        elif c.kind == "continuous":
            rows.append((c.col_id, c.name, list(c.event_types), float(events.agg(F.avg(c.expr)).first()[0])))
    for name, fit in design.splines.items():
        cols = [c for c in design.columns if c.variable == name and c.kind == "spline"]
        events = design.events.where(F.col("type").isin(*cols[0].event_types))
        if kind == "AME":
            weights = events.agg(*[F.avg(c.expr) for c in cols]).first()
        else:
            centre = [np.array([events.agg(F.avg(F.col(v).cast("double"))).first()[0]]) for v in fit.spec.variables]
            weights = np.delete(sp.evaluate(fit.spec, fit.knots, *centre)[0], fit.dropped)
        rows += [(c.col_id, name, list(c.event_types), float(w)) for c, w in zip(cols, weights, strict=True)]
    m = curves.sparkSession.createDataFrame(rows, "col_id int, other string, other_types array<string>, w double")
    means = curves.join(F.broadcast(m), "col_id").groupBy("channel", "lag", *_set(curves), "other", "other_types").agg(F.sum(F.col("beta") * F.col("w")).alias("m"))
    means = means.withColumnsRenamed({"channel": "_ch", "lag": "_lag", "set": "_set"})
    same = F.array_sort("event_types").eqNullSafe(F.array_sort("other_types"))
    on = (F.col("channel") == F.col("_ch")) & (F.col("lag") == F.col("_lag")) & same & (F.col("variable") != F.col("other"))
    on = on & (F.col("set") == F.col("_set")) if _set(curves) else on
    keys = predicted.columns
    return predicted.join(means, on, "left").groupBy(*[c for c in keys if c != "beta"]).agg((F.first("beta") + F.coalesce(F.sum("m"), F.lit(0.0))).alias("beta"))


def _r2(fit, test) -> np.ndarray:
    """1 - RSS / TSS by channel: fit's coefficients on test's statistics; nan where the test has no variance."""
    n, gram, cross, total, squares, _ = test
    rss = squares - 2 * (fit * cross).sum(0) + np.einsum("pc,pq,qc->c", fit, gram, fit)
    tss = squares - total**2 / n
    varies = tss > 1e-12 * np.maximum(squares, 1e-300)
    return np.where(varies, 1 - rss / np.where(varies, tss, 1.0), np.nan)


def _told(r: float) -> float | None:
    return None if np.isnan(r) else float(r)


def model_fit(stats: Statistics, design: Design, method: str = "R2", variables: list[str] | None = None, solver: str = "normal") -> list[tuple]:
    """(fold, channel, variable, r2_ca, r2_total): R2, partialR2, crossValR2 or crossValpartialR2, all from fold statistics.

    r2_ca is what the variable adds: the model's R2 less that of the model without it. Where a test's signal has no variance both are null.
    """
    partial, cross = "partial" in method, method.startswith("crossVal")
    if method not in ("R2", "partialR2", "crossValR2", "crossValpartialR2"):
        raise ValueError(method)
    by_col = {c.col_id: c.variable for c in design.columns}
    names = variables or list(dict.fromkeys(by_col[k] for k, _ in stats.keys if k in by_col))
    out = []
    for fold in sorted(stats.folds) if cross else [None]:
        test = stats.folds[fold] if cross else stats.total()
        train = stats.total(without=fold) if cross else test
        if not test[0] or not train[0]:
            continue
        whole = _r2(solve(train[1], train[2], solver)[0], test)
        if not partial:
            out += [(fold, ch, None, None, _told(r)) for ch, r in zip(stats.channels, whole, strict=True)]
            continue
        for name in names:
            keep = np.array([by_col.get(k) != name for k, _ in stats.keys])
            beta = np.zeros_like(train[2])
            if keep.any():
                beta[keep] = solve(train[1][np.ix_(keep, keep)], train[2][keep], solver)[0]
            without = _r2(beta, test)
            out += [(fold, ch, name, _told(r - w), _told(r)) for ch, w, r in zip(stats.channels, without, whole, strict=True)]
    return out


def _ranked(times: DataFrame, tile: int = 16_384) -> DataFrame:
    """(recording_id, t, place from 0, of: how many) of distinct times: places inside tiles and counts before them."""
    rows = times.select("recording_id", "t", F.floor(F.col("t") / tile).alias("_tile")).distinct()
    counts = rows.groupBy("recording_id", "_tile").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("recording_id")
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_tile")) - F.col("_n")).withColumn("of", F.sum("_n").over(whole)).drop("_n")
    inside = F.row_number().over(W.partitionBy("recording_id", "_tile").orderBy("t")) - 1
    return rows.withColumn("_place", inside).join(counts, ["recording_id", "_tile"]).select("recording_id", "t", (F.col("_place") + F.col("_before")).alias("place"), "of")


def folds(samples: DataFrame, events: DataFrame, fold_event: str | list[str] | None = None, n: int = 10, method: str = "event", modelled: DataFrame | None = None, allow_overlap: bool = True) -> DataFrame:
    """samples with fold, 0..: stretches between events of some types, or of equal numbers of samples.

    equalEntries: with modelled (recording_id, t), stretches of equal numbers of these; samples between
    stretches belong to the one before. event: without allow_overlap a fold event at a modelled sample raises.
    """
    if method == "equalEntries" and modelled is not None:
        ranked = _ranked(modelled)
        ranked = ranked.withColumn("_k", F.least(F.floor(F.col("place") * n / F.col("of")), F.lit(n - 1)).cast("int"))
        starts = ranked.groupBy("recording_id", "_k").agg(F.min("t").alias("_t")).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("_t", "_k"))).alias("_starts"))  # n of each recording
        out = samples.join(starts, "recording_id", "left")
        return out.withColumn("fold", F.coalesce(F.array_max(F.transform(F.filter("_starts", lambda s: s["_t"] <= F.col("t")), lambda s: s["_k"])), F.lit(0))).drop("_starts")
    if method == "equalEntries":
        ends = samples.groupBy("recording_id").agg(F.max("t").alias("_last"))
        return samples.join(F.broadcast(ends), "recording_id").withColumn("fold", F.least(F.floor((F.col("t") - 1) * n / F.col("_last")), F.lit(n - 1)).cast("int")).drop("_last")
    types = [fold_event] if isinstance(fold_event, str) else list(fold_event or [])
    if not types:
        raise ValueError("folds by event need a fold event")
    edges = events.where(F.col("type").isin(*types)).select("recording_id", F.round("latency").cast("long").alias("_t")).distinct()
    if not allow_overlap and modelled is not None and not edges.join(modelled.select("recording_id", F.col("t").alias("_t")), ["recording_id", "_t"], "left_semi").isEmpty():
        raise ValueError("fold events stand at modelled samples")
    bounds = edges.withColumn("_k", F.row_number().over(W.partitionBy("recording_id").orderBy("_t"))).withColumn("_to", F.lead("_t").over(W.partitionBy("recording_id").orderBy("_t")))
    first = edges.groupBy("recording_id").agg(F.min("_t").alias("_to")).select("recording_id", F.lit(0).cast("long").alias("_t"), F.lit(0).alias("_k"), "_to")
    bounds = bounds.select("recording_id", "_t", "_k", "_to").union(first).withColumnsRenamed({"recording_id": "_r"})
    on = (F.col("recording_id") == F.col("_r")) & (F.col("t") >= F.col("_t")) & (F.col("_to").isNull() | (F.col("t") < F.col("_to")))
    return samples.join(F.broadcast(bounds), on, "left").withColumn("fold", F.coalesce("_k", F.lit(0))).drop("_r", "_t", "_k", "_to")  # fold events are few


def fitted(xdc: DataFrame, coefs: DataFrame) -> DataFrame:
    """(recording_id, t, channel, y_hat)."""
    c = coefs.select("col_id", "basis_id", "channel", "beta")
    return xdc.join(F.broadcast(c), ["col_id", "basis_id"]).groupBy("recording_id", "t", "channel").agg(F.sum(F.col("v") * F.col("beta")).alias("y_hat"))


def residuals(samples: DataFrame, xdc: DataFrame, coefs: DataFrame) -> DataFrame:
    hat = fitted(xdc, coefs)
    return samples.join(hat, ["recording_id", "t", "channel"], "left").withColumn("y_hat", F.coalesce("y_hat", F.lit(0.0))).withColumn("residual", F.col("y") - F.col("y_hat"))


def adjusted(samples: DataFrame, xdc: DataFrame, coefs: DataFrame, keep: list[int] | None = None, remove: list[int] | None = None, add_residuals: bool = False) -> DataFrame:
    """residuals' columns with y_hat of some columns alone: keep these col_ids, or all but those to remove; add_residuals adds what no column explains."""
    if keep is not None and remove is not None:
        raise ValueError("keep or remove, not both")
    whole = residuals(samples, xdc, coefs)
    some = coefs if keep is None and remove is None else coefs.where(F.col("col_id").isin(*keep)) if keep is not None else coefs.where(~F.col("col_id").isin(*remove))
    part = fitted(xdc, some).withColumnRenamed("y_hat", "_part")
    out = whole.join(part, ["recording_id", "t", "channel"], "left").withColumn("y_hat", F.coalesce("_part", F.lit(0.0))).drop("_part")
    return out.withColumn("y_hat", F.col("y_hat") + F.col("residual")) if add_residuals else out


def own_responses(long: DataFrame, curves: DataFrame) -> DataFrame:
    """(recording_id, event_index, channel, lag, y_hat): what the model says of each event by itself, without its neighbours' overlap."""
    return long.join(curves, "col_id").groupBy("recording_id", "event_index", "channel", "lag").agg(F.sum(F.col("x") * F.col("beta")).alias("y_hat"))


def single_trials(events: DataFrame, signal: DataFrame, lo: int, width: int, kind: str = "raw", align_to: str | None = None, sort_by: str = "latency", descending: bool = False, split_by: str | None = None) -> DataFrame:
    """(trial, event_index, lag, y [, facet]): epochs of raw, modelled (y_hat) or residual signal, averaged over channels, in order."""
    from kernelweave.operators.intervals import epochs

    column = {"raw": "y", "modelled": "y_hat", "residual": "residual"}[kind]
    e = events if align_to is None else events.where(F.col("type") == align_to)
    cut = epochs(e, signal.select("recording_id", "t", "channel", F.col(column).alias("y")), lo, width)
    mean = cut.groupBy("recording_id", "event_index", "lag").agg(F.avg("y").alias("y"))
    order = [F.col("_s").desc() if descending else F.col("_s"), F.col("event_index")]
    keys = e.select("recording_id", "event_index", F.col(sort_by).alias("_s"), *([F.col(split_by).alias("facet")] if split_by else []))
    kept = keys.join(cut.select("recording_id", "event_index").distinct(), ["recording_id", "event_index"], "left_semi")
    kept = kept.withColumn("trial", F.row_number().over(W.partitionBy("recording_id").orderBy(*order)))
    return mean.join(kept, ["recording_id", "event_index"]).select("trial", "event_index", "lag", "y", *(["facet"] if split_by else []))
