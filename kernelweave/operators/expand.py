"""Time expansion: events spread over windows of lags, in sticks or smooth time bases, and lagged signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.functions.scan import TILE, scan
from kernelweave.functions.splines import cubic_values


def window(limits: tuple[float, float], srate: float) -> tuple[int, int]:
    """(first lag, number of lags) of a window in seconds: from round(t0 srate) up to round(t1 srate) - 1."""
    lo, hi = (int(np.floor(abs(t) * srate + 0.5)) * (1 if t >= 0 else -1) for t in limits)
    if hi <= lo:
        raise ValueError("an empty window")
    return lo, hi - lo


def single(long: DataFrame, ties: str = "last") -> DataFrame:
    """Whole latencies; of a column's events at one sample the last by event_index counts (or the sum)."""
    rounded = long.withColumn("lat", F.round("latency").cast("long"))
    keys = ["recording_id", "col_id", "lat"]
    if ties == "sum":
        return rounded.groupBy(*keys).agg(F.sum("x").alias("x"))
    return rounded.groupBy(*keys).agg(F.max_by("x", "event_index").alias("x"))


def missing() -> Column:
    """Raises when it is read."""
    return F.raise_error(F.lit("an event misses a covariate: impute it or drop the event")).cast("double")


def known(x: str) -> Column:
    """The column; a missing value raises when it is read."""
    return F.coalesce(F.col(x), missing())


def sticks(events: DataFrame, lo: int, width: int, n_samples: DataFrame | int) -> DataFrame:
    """(recording_id, t, col_id, basis_id, v): an exploded equi-join key for each event and lag inside 1..n.

    n_samples: of all recordings, or a table (recording_id, n_samples). Missing covariates raise.
    """
    out = events.where(known("x") != 0).select("recording_id", "col_id", "lat", "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("basis_id"))
    out = out.withColumn("t", F.col("lat") + F.col("basis_id") + F.lit(lo))
    if isinstance(n_samples, int):
        out = out.where(F.col("t").between(1, n_samples))
    else:
        out = out.join(n_samples, "recording_id").where("t between 1 and n_samples")
    return out.select("recording_id", "t", "col_id", F.col("basis_id").cast("int"), F.col("x").alias("v"))


def time_basis(method: str, width: int, n: int = 30) -> np.ndarray:
    """functions x lags. stick: identity; splines: cubic over linspace(1, width, n - 2); fourier: constant, then cosine and -sine of each frequency."""
    if method in ("stick", "full"):
        return np.eye(width)
    if method in ("spline", "splines"):
        n = min(n, width)
        if n < 3:
            raise ValueError("at least 3 functions")
        return cubic_values(np.arange(1, width + 1), np.linspace(1, width, max(n - 2, 2))).T
    if method == "fourier":
        n = min(2 * n, width)
        n -= 1 - n % 2 if n < width else 0
        turn = 2 * np.pi * np.arange(width) / width
        rows = [np.ones(width)]
        k = 1
        while len(rows) < n:
            rows += [np.cos(k * turn), -np.sin(k * turn)]
            k += 1
        return np.array(rows[:n])
    raise ValueError(method)


def basis_table(spark, basis: np.ndarray) -> DataFrame:
    rows = [(int(b), int(lag), float(w)) for b, lag in zip(*np.nonzero(basis), strict=True) for w in [basis[b, lag]]]
    return spark.createDataFrame(rows, "function int, lag int, w double")


def in_basis(xdc: DataFrame, basis: np.ndarray) -> DataFrame:
    """Sticks weighted into a time basis: (recording_id, t, col_id, basis_id, v)."""
    b = F.broadcast(basis_table(xdc.sparkSession, basis))  # functions x lags, of a model's size
    out = xdc.join(b, xdc["basis_id"] == b["lag"]).groupBy("recording_id", "t", "col_id", F.col("function").alias("basis_id"))
    return out.agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def lagged(samples: DataFrame, channel: int, lo: int, width: int, col_id: int) -> DataFrame:
    """A channel as predictor of all: its sample at t - lag, for each lag; zeros outside of the recording."""
    x = samples.where(F.col("channel") == channel)
    ends = x.groupBy("recording_id").agg(F.max("t").alias("n_samples"))
    out = x.select("recording_id", (F.col("t") + F.lit(lo)).alias("from"), F.col("y").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("basis_id"))
    out = out.withColumn("t", F.col("from") + F.col("basis_id")).join(ends, "recording_id").where("t between 1 and n_samples and v <> 0")
    return out.select("recording_id", "t", F.lit(col_id).alias("col_id"), F.col("basis_id").cast("int"), "v")


def convolved(vector: DataFrame, kernel: list[float]) -> DataFrame:
    """(recording_id, t, v): a sparse vector's full convolution with a short kernel."""
    k = F.array(*map(F.lit, map(float, kernel)))
    out = vector.select("recording_id", "t", "v", F.posexplode(k).alias("lag", "w"))
    return out.groupBy("recording_id", (F.col("t") + F.col("lag")).alias("t")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gaps(events: DataFrame, time: str = "latency", order: str = "event_index", tile: int = TILE) -> DataFrame:
    """Next and previous event's distance in table order, by recording; order is a number, and a recording is scanned in tiles of it."""
    near = scan(events, ["recording_id"], [order], {"_next": ("next", time), "_last": ("last", time)}, tile)
    return near.withColumn("next_gap", F.col("_next") - F.col(time)).withColumn("previous_gap", F.col(time) - F.col("_last")).drop("_next", "_last")


def with_column(xdc: DataFrame, extra: DataFrame, col_id: int, basis_id: int = -1) -> DataFrame:
    """Appends a ready-made column (recording_id, t, v) that is not spread over lags."""
    return xdc.unionByName(extra.where("v <> 0").select("recording_id", "t", F.lit(col_id).alias("col_id"), F.lit(basis_id).alias("basis_id"), "v"))
