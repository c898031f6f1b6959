"""Two-level scans, ranges inside groups, and what is built on them, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import stats
from kernelweave.functions.scan import scan
from kernelweave.operators import expand, intervals


@pytest.mark.parametrize("tile", [3, 50, 10_000])
def test_scan(spark, tile):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 400, p=[0.8, 0.15, 0.05]), "t": rng.permutation(5000)[:400], "v": rng.normal(size=400)})
    pdf.loc[rng.random(400) < 0.1, "v"] = np.nan
    df = spark.createDataFrame([(None if pd.isna(g) else g, int(t), None if np.isnan(v) else float(v)) for g, t, v in pdf.itertuples(index=False)], "g string, t long, v double")
    got = scan(df, ["g"], ["t"], {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "was": ("last", "v"), "then": ("next", "v")}, tile).toPandas().sort_values("t")
    pdf = pdf.sort_values("t")
    each = pdf.groupby("g", dropna=False)["v"]
    assert len(got) == 400
    want = pd.DataFrame({
        "s": each.transform(lambda v: v.fillna(0).cumsum().shift(fill_value=0)), "hi": each.transform(lambda v: v.cummax().ffill().shift()), "lo": each.transform(lambda v: v.cummin().ffill().shift()),
        "was": each.transform(lambda v: v.shift()), "then": each.transform(lambda v: v.shift(-1)),
    })
    for c in want:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c


def islands(rows, within):
    out = []
    for g, a, b in sorted(rows):
        if out and out[-1][0] == g and a <= out[-1][2] + within:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([g, a, b])
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("tile", "within"), [(4, 0), (4, 3), (64, 1), (10_000, 0)])
def test_merge_over_borders(spark, tile, within):
    rng = np.random.default_rng(tile + within)
    rows = [("r", int(a), int(a + n)) for a, n in zip(rng.integers(0, 900, 150), rng.integers(0, 9, 150), strict=True)] + [("r", 100, 400), ("s", 5, 5), ("s", 5, 5), ("s", 7, 6)]
    df = spark.createDataFrame(rows, "recording_id string, start_t long, end_t long")
    assert sorted(map(tuple, intervals.merge(df, within, tile=tile).collect())) == islands([r for r in rows if r[1] <= r[2]], within)


@pytest.mark.parametrize("tile", [5, 1000])
def test_runs_and_gaps_over_borders(spark, tile):
    rng = np.random.default_rng(4)
    t = np.flatnonzero(rng.random(300) < 0.8)
    df = spark.createDataFrame([("r", int(x)) for x in t] + [("r", int(t[0]))], "recording_id string, t long")
    assert sorted(map(tuple, intervals.runs(df, tile=tile).collect())) == islands([("r", int(x), int(x)) for x in t], 1)
    ev = pd.DataFrame({"recording_id": rng.choice(["a", "b"], 60), "event_index": rng.permutation(200)[:60], "latency": rng.random(60)})
    got = expand.gaps(spark.createDataFrame(ev), tile=tile).toPandas().sort_values("event_index")
    lat = ev.sort_values("event_index").groupby("recording_id")["latency"]
    assert np.allclose(got["next_gap"], lat.shift(-1) - ev.sort_values("event_index")["latency"], equal_nan=True) and np.allclose(got["previous_gap"], ev.sort_values("event_index")["latency"] - lat.shift(), equal_nan=True)


def test_sets_of_intervals(spark):
    one = spark.createDataFrame([("r", 1, 10), ("r", 5, 20)], "recording_id string, start_t long, end_t long")
    two = spark.createDataFrame([("r", 16, 30), ("s", 1, 5)], "recording_id string, start_t long, end_t long")
    union, totals = intervals.merge_sets({"one": one, "two": two}, 10.0)
    assert sorted(map(tuple, union.collect())) == [("r", 1, 30), ("s", 1, 5)]
    assert {r["name"]: r["seconds"] for r in totals.collect()} == {"one": 2.0, "two": 2.0, "union": 3.5, "repeated": 0.5}


def test_quantiles_inside_groups(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.9, "hot", "cold"), "x": np.round(rng.normal(size=3000), 2)})
    df = spark.createDataFrame(pdf)
    got = stats.hazen(df, "x", [0.0, 0.1, 0.37, 0.5, 1.0], ["g"]).toPandas()
    for r in got.itertuples():
        assert r.q == pytest.approx(np.quantile(pdf["x"][pdf["g"] == r.g], r.p, method="hazen"))
    got = stats.hazen(df, "x", [0.1, 0.9], ["g"], rule="linear").toPandas()
    for r in got.itertuples():
        assert r.q == pytest.approx(np.quantile(pdf["x"][pdf["g"] == r.g], r.p))
    tiles = stats.tiled(df, "x", ["g"]).groupBy("g", "_tile").count().toPandas()
    hot = tiles[tiles["g"] == "hot"]["count"]
    assert len(hot) > 40 and hot.max() < 0.1 * hot.sum()  # one group is many tiles
    assert len(got) == 4 and stats.hazen(df.where("x > 99"), "x", [0.5], ["g"]).count() == 0
    trimmed = {r["g"]: r["trimmed"] for r in stats.trimmed_mean(df, "x", ["g"]).collect()}
    for g, x in pdf.groupby("g")["x"]:
        k, v = int(len(x) * 0.1), np.sort(x)
        assert trimmed[g] == pytest.approx(v[k : len(v) - k].mean())


def test_yuen_from_counts(spark):
    rng = np.random.default_rng(8)
    a = np.round(rng.normal(size=40), 1)
    b = np.round(a + rng.normal(0.4, 1, size=40), 1)
    got = stats.yuen_dependent(spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b, strict=True)], "g string, a double, b double"), "a", "b", ["g"]).first()
    g = 8
    wins = lambda v: np.clip(v, np.sort(v)[g], np.sort(v)[len(v) - g - 1])
    h, wa, wb = 40 - 2 * g, wins(a), wins(b)
    se = np.sqrt((wa.var(ddof=1) + wb.var(ddof=1) - 2 * np.cov(wa, wb)[0, 1]) * 39 / (h * (h - 1)))
    diff = np.sort(a)[g : 40 - g].mean() - np.sort(b)[g : 40 - g].mean()
    assert got["diff"] == pytest.approx(diff) and got["se"] == pytest.approx(se) and got["t"] == pytest.approx(diff / se)


def test_no_window_over_a_recording(spark):
    df = spark.range(10).select(F.lit("r").alias("recording_id"), F.col("id").alias("t"), F.col("id").alias("event_index"), F.col("id").cast("double").alias("latency"))
    for out in (intervals.runs(df), expand.gaps(df)):
        plan = out._jdf.queryExecution().analyzed().toString()
        deep = [line for line in plan.splitlines() if "Window [" in line and "recording_id" in line and "_tile" not in line]
        assert not deep
