"""Bursts told from the covariance of channels: windows whose components leave the range that a recording's clean part has.

A recording's usual covariance is the geometric median over its windows, found by reweighted sums; on its principal axes each
window has an amplitude, and the median and deviation of these give thresholds. A window's own components that pass what the
thresholds allow in their direction would be rebuilt from the others; samples that this changes are flagged. A burst that
all channels share shows here though no channel by itself is large.

Nothing of a recording meets in one task: windows are covariances in a stored table, medians come from sums and from ranges of values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.functions.stats import hazen
from kernelweave.operators import packed
from kernelweave.operators.intervals import eye_channels, runs

#: Windows of a tile: what one call of Python takes.
WINDOWS = 64
#: Of the components at most this share is rebuilt.
MOST = 2 / 3


def windows(samples: DataFrame, channels: list[int], length: int) -> DataFrame:
    """(recording_id, window, v): covariances (channels x channels doubles) of windows of `length` samples, each half a window after the last.

    Windows that lack a sample in some channel are left out.
    """
    half, c = max(1, length // 2), len(channels)
    last = F.floor((F.col("t") - 1) / half)  # the latest window that has the sample
    tiles = F.array_distinct(F.array(F.floor(last / WINDOWS), F.floor(F.greatest(last - (length - 1) // half, F.lit(0)) / WINDOWS)))
    s = samples.where(F.col("channel").isin(*channels) & F.col("y").isNotNull()).select("recording_id", "t", "channel", "y", F.explode(tiles).alias("tile"))

    def of(key, rows: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[1]) * WINDOWS * half + 1
        x = np.full(((WINDOWS - 1) * half + length, c), np.nan)
        at = rows["t"].to_numpy() - lo
        ok = (at >= 0) & (at < len(x))
        x[at[ok], np.searchsorted(channels, rows["channel"].to_numpy()[ok])] = rows["y"].to_numpy()[ok]
        out = []
        for i in range(WINDOWS):
            w = x[i * half : i * half + length]
            if not np.isnan(w).any():
                out.append((key[0], int(key[1]) * WINDOWS + i, (w.T @ w / length).tobytes()))
        return pd.DataFrame(out, columns=["recording_id", "window", "v"])

    return s.groupBy("recording_id", "tile").applyInPandas(of, "recording_id string, window long, v binary")


def centre(table: DataFrame, c: int, rounds: int = 12) -> DataFrame:
    """(recording_id, m): the geometric median of each recording's covariances, by reweighted means."""

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, m in zip(b.column("v"), b.column("m"), strict=True):
                v = np.frombuffer(v.as_buffer())
                far = 1.0 if not m.is_valid else 1 / max(np.linalg.norm(v - np.frombuffer(m.as_buffer())), 1e-12 * (1 + np.linalg.norm(v)))
                out.append(np.concatenate([[far], far * v]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("recording_id"), pa.array(out, pa.binary())], ["recording_id", "v"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [np.frombuffer(v.as_buffer()) for v in b.column("v")]
            yield pa.RecordBatch.from_arrays([b.column("recording_id"), pa.array([(s[1:] / s[0]).tobytes() for s in sums], pa.binary())], ["recording_id", "m"])

    found = None
    for _ in range(rounds):
        pairs = table.withColumn("m", F.lit(None).cast("binary")) if found is None else table.join(found, "recording_id")
        sums = packed.summed(pairs.select("recording_id", "v", "m").mapInArrow(weighted, "recording_id string, v binary"), "recording_id")
        new = packed.stored(sums.mapInArrow(mean, "recording_id string, m binary"), "centres")
        if found is not None:
            packed.dropped(found)
        found = new
    return found


def _axes(m: np.ndarray, c: int) -> np.ndarray:
    """The principal axes of a covariance as columns."""
    return np.linalg.eigh(m.reshape(c, c))[1]


def repaired(samples: DataFrame, srate: float, cutoff: float = 20.0, seconds: float = 0.5, tolerance: float = 1e-5, channels: list[int] | None = None, labels: dict[int, str] | None = None) -> DataFrame:
    """(recording_id, start_t, end_t) of the samples that a repair changes by tolerance or more, summed over channels.

    cutoff: deviations above the median amplitude of an axis. Eye channels raise. Recordings without a whole window give no rows.
    """
    if eyes := eye_channels(labels, channels):
        raise ValueError(f"eye channels take part: {eyes}")
    names = sorted(r[0] for r in samples.select("channel").distinct().collect() if channels is None or r[0] in channels)
    c, length = len(names), max(2, int(srate * seconds))
    half = max(1, length // 2)
    if not names:
        return samples.select("recording_id", F.col("t").alias("start_t"), F.col("t").alias("end_t")).limit(0)
    table = packed.stored(windows(samples, names, length), "covariances")
    centres = centre(table, c)

    def amplitudes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, axis, size = [], [], []
            for r, v, m in zip(b.column("recording_id").to_pylist(), b.column("v"), b.column("m"), strict=True):
                a = _axes(np.frombuffer(m.as_buffer()), c)
                x = np.frombuffer(v.as_buffer()).reshape(c, c)
                rec += [r] * c
                axis += range(c)
                size += np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", a, x, a), 0.0)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.string()), pa.array(axis, pa.int32()), pa.array(size, pa.float64())], ["recording_id", "axis", "size"])

    with_centre = table.join(centres, "recording_id").select("recording_id", "window", "v", "m")
    sizes = packed.stored(with_centre.mapInArrow(amplitudes, "recording_id string, axis int, size double"), "amplitudes")
    keys = ["recording_id", "axis"]
    mid = hazen(sizes, "size", [0.5], keys).select(*keys, F.col("q").alias("mid"))
    off = sizes.join(mid, keys).withColumn("off", F.abs(F.col("size") - F.col("mid")))
    limits = mid.join(hazen(off, "off", [0.5], keys).select(*keys, (F.col("q") * 1.4826).alias("dev")), keys)
    limits = limits.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", (F.col("mid") + F.lit(cutoff) * F.col("dev")).alias("limit")))), lambda x: x["limit"]).alias("limits"))  # one for each channel

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the windows that change the matrix that rebuilds their samples."""
        for b in batches:
            rec, win, out = [], [], []
            for r, w, v, m, limit in zip(b.column("recording_id").to_pylist(), b.column("window").to_pylist(), b.column("v"), b.column("m"), b.column("limits").to_pylist(), strict=True):
                centre_ = np.frombuffer(m.as_buffer()).reshape(c, c)
                axes = _axes(centre_, c)
                power, own = np.linalg.eigh(np.frombuffer(v.as_buffer()).reshape(c, c))
                allowed = ((np.array(limit)[:, None] * (axes.T @ own)) ** 2).sum(0)
                keep = (power <= allowed) | (np.arange(c) < c - int(MOST * c))
                if keep.all():
                    continue
                d, e = np.linalg.eigh(centre_)
                root = e @ np.diag(np.sqrt(np.maximum(d, 0))) @ e.T
                rec.append(r)
                win.append(w)
                out.append((root @ np.linalg.pinv(keep[:, None] * (own.T @ root)) @ own.T).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.string()), pa.array(win, pa.int64()), pa.array(out, pa.binary())], ["recording_id", "window", "r"])

    found = packed.stored(with_centre.join(limits, "recording_id").mapInArrow(rebuilt, "recording_id string, window long, r binary"), "rebuilt")
    latest = F.floor((F.col("t") - 1) / half)
    own = samples.where(F.col("channel").isin(*names)).withColumn("window", F.explode(F.sequence(F.greatest(latest - (length - 1) // half, F.lit(0)), latest))).select("recording_id", "window", "t", "channel", "y")
    own = own.join(found.select("recording_id", "window"), ["recording_id", "window"], "left_semi")

    def changed(key, rows: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(matrix):
            return pd.DataFrame({"recording_id": [], "t": []})
        t, place = np.unique(rows["t"].to_numpy(), return_inverse=True)
        x = np.zeros((len(t), c))
        x[place, np.searchsorted(names, rows["channel"].to_numpy())] = rows["y"].to_numpy()
        inside = (t > int(key[1]) * half) & (t <= int(key[1]) * half + length)
        off_ = np.abs(x - x @ np.frombuffer(matrix["r"].iloc[0]).reshape(c, c).T).sum(1)
        t = t[inside & (off_ >= tolerance)]
        return pd.DataFrame({"recording_id": [key[0]] * len(t), "t": t})

    mask = own.groupBy("recording_id", "window").cogroup(found.groupBy("recording_id", "window")).applyInPandas(changed, "recording_id string, t long")
    out = packed.stored(runs(mask), "bursts")
    packed.dropped(table, centres, sizes, found)
    return out
