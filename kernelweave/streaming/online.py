"""Beyond the reference: running statistics and artefact flags over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n and sums for a straight line of y on x, a stateful sum for each key; `slope` turns them into a fit at any time."""
    a, b = F.col(x), F.col(y)
    return stream.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))


def slope(moments: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / d
    return moments.where(d > 0).select(*keys, "n", s.alias("slope"), ((F.col("sy") - s * F.col("sx")) / F.col("n")).alias("intercept"))


def amplitude_flags(stream: DataFrame, time: str, keys: list[str], value: str, threshold: float, window: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sliding windows whose peak-to-peak passes the threshold; late rows are dropped after the watermark."""
    w = stream.withWatermark(time, late).groupBy(*keys, F.window(time, window, slide)).agg((F.max(value) - F.min(value)).alias("range"))
    return w.where(F.col("range") > threshold).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "range")


def pause_folds(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of events apart by more than gap: session windows with counts."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
