"""Signals with known kernels: superpositions of kernels at events, named scenarios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kernel(shape: str, width: int) -> list[float]:
    """box, hanning, dirac or posneg, of `width` samples."""
    if shape == "box":
        return [1.0] * width
    if shape == "dirac":
        return [1.0] + [0.0] * (width - 1)
    if shape == "posneg":
        half = width // 2
        return [1.0] * half + [-1.0] * (width - half)
    if shape == "hanning":
        return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, width + 1) / (width + 1))).tolist()
    raise ValueError(shape)


def superpose(events: DataFrame, effects: dict[str, dict[str, float]], shape: list[float], n_samples: int, noise: float = 0.0, seed: int = 1, channels: int = 1) -> DataFrame:
    """samples: for each event its kernel, scaled by 1 x intercept + covariate x effect .. of its type, cut at the end.

    effects: {type: {"1": 3.0, "load": 0.5}}.
    """
    size = F.lit(0.0)
    for kind, parts in effects.items():
        x = sum((F.lit(v) * (F.lit(1.0) if c == "1" else F.col(c).cast("double")) for c, v in parts.items()), F.lit(0.0))
        size = F.when(F.col("type") == kind, x).otherwise(size)
    k = F.array(*map(F.lit, map(float, shape)))
    spread = events.select("recording_id", F.round("latency").cast("long").alias("lat"), size.alias("size")).select("recording_id", "lat", "size", F.posexplode(k).alias("lag", "w"))
    sums = spread.groupBy("recording_id", (F.col("lat") + F.col("lag")).alias("t")).agg(F.sum(F.col("size") * F.col("w")).alias("s"))
    every = events.select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_samples).cast("long"))).alias("t"))
    out = every.join(sums, ["recording_id", "t"], "left").select("recording_id", "t", F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("channel"), F.coalesce("s", F.lit(0.0)).alias("y"))
    return out.withColumn("y", F.col("y") + F.randn(seed) * noise) if noise else out


@dataclass(frozen=True)
class Scenario:
    """types: predictors of each event type as (name, draw, effect); draw: 1x2 or (low, high). overlap: 0 to 1."""

    types: dict[str, list[tuple[str, object, float]]]
    overlap: float = 0.0


def _a(*more, overlap=0.0):
    return Scenario({"stimulusA": [("1", None, 3.0), *more]}, overlap)


_COND = {"B": ("conditionA", "1x2", 1.0), "C": ("continuousA", (0, 100), 0.02)}
_THREE = {"stimulusA": [("1", None, 3.0)], "stimulusB": [("1", None, 3.0), _COND["B"]], "stimulusC": [("1", None, 3.0), _COND["B"], _COND["C"]]}
#: Scenarios with straight effects; those with splines draw `spline` predictors of effect x^3.
SCENARIOS = {
    1: _a(), 2: _a(overlap=0.4), 3: _a(("conditionA", "1x2", 1.0)), 4: _a(("conditionA", "1x2", 0.0), overlap=0.85), 5: _a(("continuousA", (0, 100), 0.02)),
    6: _a(("continuousA", (0, 100), 0.0), overlap=0.4), 7: _a(("splineA", (-2, 2), 0.01)), 8: _a(("splineA", (-2, 2), 0.01), overlap=1.0),
    9: Scenario({"stimulusA": [("1", None, 3.0)], "stimulusB": [("1", None, 3.0)]}), 10: Scenario({"stimulusA": [("1", None, 3.0)], "stimulusB": [("1", None, 3.0)]}, 0.4),
    11: Scenario({f"stimulus{c}": [("1", None, 3.0)] for c in "ABC"}), 12: Scenario({f"stimulus{c}": [("1", None, 3.0)] for c in "ABC"}, 0.4),
    13: Scenario(_THREE), 14: Scenario(_THREE, 0.8),
    15: Scenario({"stimulus1": [("1", None, 3.0)], "stimulus2": [("1", None, 3.0), _COND["B"], _COND["C"]], "stimulus3": [("1", None, 3.0), ("splineA", (-2, 2), 0.01), ("splineB", (-2, 2), 0.01), _COND["C"]]}, 0.5),
    16: _a(("conditionA", "1x2", 1.0), ("continuousA", (0, 100), 1.0), ("contB", (0, 100), -1.0), ("splineA", (-2, 2), 0.01), overlap=0.8),
}


def scenario_events(spark: SparkSession, number: int, seconds: int = 600, srate: float = 10.0, seed: int = 1) -> DataFrame:
    """Events of a scenario: seeded draws in Spark, gaps log-normal about 1 - overlap seconds, summed by a window."""
    s = SCENARIOS[number]
    names = sorted(s.types)
    mean, var = max(1000 * (1 - s.overlap) * 1.2 + 200, 1.0), 100.0**2
    mu, sigma = float(np.log(mean**2 / np.sqrt(var + mean**2))), float(np.sqrt(np.log1p(var / mean**2)))
    n = int(seconds * 1000 / mean) + 1
    e = spark.range(n).select(F.col("id").alias("event_index"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("type"), F.ceil(F.exp(F.randn(seed) * sigma + mu) * srate / 1000).alias("gap"))
    e = e.withColumn("recording_id", F.lit(f"scenario{number}")).withColumn("latency", F.sum("gap").over(W.partitionBy("recording_id").orderBy("event_index")).cast("double"))
    for i, name in enumerate(sorted({p[0] for t in s.types.values() for p in t if p[0] != "1"})):
        draws = {k: d for k, t in s.types.items() for p, d, _ in t if p == name}
        kind = next(iter(draws.values()))
        x = (F.rand(seed + 10 + i) < 0.5).cast("double") if kind == "1x2" else F.rand(seed + 10 + i) * (kind[1] - kind[0]) + kind[0]
        e = e.withColumn(name, F.when(F.col("type").isin(*draws), x))
    return e.drop("gap").where(F.col("latency") <= seconds * srate)


def scenario(spark: SparkSession, number: int, seconds: int = 600, srate: float = 10.0, noise: float = 0.0, shape: str = "box", seed: int = 1, channels: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, events) of a named scenario. Its draws are seeded by partition, so the events are written down first by callers that read them twice."""
    e = scenario_events(spark, number, seconds, srate, seed)
    parts = {}
    for kind, predictors in SCENARIOS[number].types.items():
        parts[kind] = {}
        for name, _, effect in predictors:
            if name.startswith("spline"):
                e = e.withColumn(f"{name}_cubed", F.pow(F.col(name), F.lit(3.0)))
                name = f"{name}_cubed"
            parts[kind][name] = effect
    return superpose(e, parts, kernel(shape, int(srate)), int(seconds * srate), noise, seed, channels), e


def tutorial(spark: SparkSession, kind: str = "2x2", seconds: int = 60, srate: float = 20.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, events) of the tutorials: two factors (2x2), with a random channel that drives the signal (trf), or a response to sort by (erpimage)."""
    if kind not in ("2x2", "trf", "erpimage"):
        raise ValueError(kind)
    n = int(seconds / 0.6)
    e = spark.range(n).select(F.lit("tutorial").alias("recording_id"), F.col("id").alias("event_index"), F.lit("fixation").alias("type"), F.round((F.col("id") + 0.5 + F.rand(seed) / 3) * 0.6 * srate).alias("latency"))
    e = e.withColumn("face", (F.rand(seed + 1) < 0.5).cast("double")).withColumn("green", (F.rand(seed + 2) < 0.5).cast("double"))
    e = e.withColumn("stimulusType", F.when(F.col("face") == 1, "face").otherwise("car")).withColumn("color", F.when(F.col("green") == 1, "green").otherwise("red"))
    if kind == "erpimage":
        e = e.withColumn("reaction", F.lit(0.2) + F.rand(seed + 3) / 5)
    s = superpose(e, {"fixation": {"1": 3.0, "face": 1.5, "green": -0.5}}, kernel("hanning", int(srate * 0.5)), int(seconds * srate))
    if kind != "trf":
        return s, e
    drive = s.select("recording_id", "t", F.lit(2).alias("channel"), F.randn(seed + 4).alias("y"))
    return s.unionByName(drive), e
