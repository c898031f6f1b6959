import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import stats
from kernelweave.functions.sql import polynomial
from kernelweave.operators import expand, fit, intervals, lsmr, plotdata, postfit
from kernelweave.operators.design import add_spline, design
from kernelweave.sources import simulate


@pytest.mark.parametrize("noise", [0.0, 1.0])
@pytest.mark.parametrize("condition", [1.0, 100.0])
def test_lsmr_is_least_squares(noise, condition):
    rng = np.random.default_rng(0)
    u, _, vt = np.linalg.svd(rng.normal(size=(300, 40)), full_matrices=False)
    a = u * np.geomspace(1, 1 / condition, 40) @ vt
    a /= np.linalg.norm(a, axis=0)
    y = a @ rng.normal(size=(40, 3)) + noise * rng.normal(size=(300, 3))
    y[:, 2] = 0
    got = lsmr.lsmr(lsmr.Dense(a, y), atol=1e-13, btol=1e-13, iterations=2000)
    assert np.abs(got.x - np.linalg.lstsq(a, y, rcond=None)[0]).max() < 1e-8 and got.converged
    assert got.status[2] == "zero" and set(got.status[:2]) == {"least squares" if noise else "residual"}
    ridge = lsmr.lsmr(lsmr.Dense(a, y), damp=0.5, atol=1e-12, btol=0.0)
    assert np.allclose(ridge.x, np.linalg.solve(a.T @ a + 0.25 * np.eye(40), a.T @ y), atol=1e-8)


def test_lsmr_says_why_it_stopped():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 20)) @ np.diag(np.geomspace(1, 1e-6, 20))
    y = rng.normal(size=(60, 1))
    few, bad = lsmr.lsmr(lsmr.Dense(a, y), iterations=2), lsmr.lsmr(lsmr.Dense(a, y), atol=0.0, btol=0.0, limit=1e3)
    assert few.status == ["steps"] and bad.status == ["condition"] and not few.converged and not bad.converged


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i % 2}", i, "a" if i % 3 else "b", float(t), float(rng.normal())) for i, t in enumerate(np.cumsum(rng.integers(2, 9, 120)))]
    e = spark.createDataFrame(rows, "recording_id string, event_index long, type string, latency double, u double")
    s = simulate.superpose(e, {"a": {"1": 3.0, "u": 2.5}, "b": {"1": 1.0}}, simulate.kernel("hanning", 6), 800, channels=2)
    d = design(e, ["y~1+u", "y~1"], [["a"], ["b"]])
    return e, s, d, expand.sticks(expand.single(d.long()), 0, 6, 800)


def test_rows_equal_the_gram(model):
    e, s, d, x = model
    noisy = s.withColumn("y", F.col("y") + F.sin(F.col("t") * 7.0) * F.col("channel"))
    a, b = ({(r["channel"], r["col_id"], r["basis_id"]): r["beta"] for r in fit.fit_overlap(x, noisy, m).collect()} for m in ("lsmr", "normal"))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-5) for k in a)
    with pytest.warns(UserWarning, match="steps"):
        fit.fit_overlap(x, noisy, "lsmr", iterations=2)
    with pytest.raises(Exception, match="miss values"):
        fit.fit_overlap(x, noisy.withColumn("y", F.when(F.col("channel") == 1, F.col("y"))), "lsmr")
    empty = lsmr.fit(x.limit(0), noisy)
    assert empty[0] == [] and empty[2].x.shape == (0, 2)


def test_sets_parts_and_tables(model):
    e, s, d, x = model
    c = fit.fit_overlap(x, s)
    both = fit.beta_sets(one=c, two=c.withColumn("beta", F.col("beta") * 2))
    curves = postfit.condense(both, np.eye(6), 0, 1.0)
    p = {(r["set"], r["variable"], r["value"]): r["beta"] for r in postfit.predict(curves, d, {"u": [1.0]}).where("channel = 1 and lag = 2").collect()}
    assert p["two", "u", 1.0] == pytest.approx(2 * p["one", "u", 1.0]) and p["one", "(Intercept)", None] > 0
    table = plotdata.curve_table(curves, d.metadata(), (0.0, 1.0), True).where("channel = 1 and time_s = 0.0")
    assert table.count() == 6 and table.agg(F.sum(F.abs("beta"))).first()[0] == pytest.approx(0, abs=1e-9)
    m = postfit.marginal(postfit.predict(curves, d, {"u": [1.0]}), curves, d).where("channel = 1 and lag = 2 and kind = 'continuous'").collect()
    assert {r["set"]: r["beta"] for r in m}["two"] == pytest.approx(2 * {r["set"]: r["beta"] for r in m}["one"])
    rest = postfit.adjusted(s, x, c, remove=[0, 1, 2], add_residuals=True)
    assert rest.agg(F.max(F.abs(F.col("y_hat") - F.col("residual")))).first()[0] == pytest.approx(0, abs=1e-9)
    own = postfit.own_responses(d.long(), curves.where("set = 'one'").drop("set")).where("channel = 1")
    b = own.join(e.where("type = 'b'"), ["recording_id", "event_index"]).groupBy("lag").agg(F.avg("y_hat").alias("m"))
    assert {r["lag"]: r["m"] for r in b.collect()}[3] == pytest.approx(simulate.kernel("hanning", 6)[3])
    with pytest.raises(ValueError):
        postfit.adjusted(s, x, c, keep=[0], remove=[1])


def test_custom_spline_in_designs_and_predictions(model):
    e, s, _, _ = model
    d = add_spline(design(e, "y~1", ["a"]), "u", ["a"], polynomial, n=2, name="powers")
    assert len(d.columns) == 2 and d.columns[1].kind == "spline" and d.splines["powers"].dropped in (0, 1)
    curves = postfit.condense(fit.fit_overlap(expand.sticks(expand.single(d.long()), 0, 6, 800), s), np.eye(6), 0, 1.0)
    p = postfit.predict(curves, d, {"powers": [0.5, 1.0]}).where("variable = 'powers' and channel = 1 and lag = 2").orderBy("value").collect()
    assert p[0]["beta"] / p[1]["beta"] == pytest.approx(0.5 if d.splines["powers"].dropped == 1 else 0.25)
    with pytest.raises(ValueError):
        add_spline(d, "u", ["a"], polynomial, n=2, name="powers")


def test_eye_channels(model):
    _, s, _, _ = model
    with pytest.warns(UserWarning, match="eye"):
        intervals.amplitude(s, 1.0, labels={1: "Cz", 2: "Pupil-L"})
    for of in (intervals.improbable, intervals.bursts):
        with pytest.raises(ValueError, match="eye"):
            of(s, 1.0, labels={1: "L-EYE-X"})
    assert intervals.eye_channels({1: "Eye", 2: "Cz"}, [2]) == [] and intervals.eye_channels(None) == []


def test_events_in_epochs(spark):
    rows = [("r", 1, "a", 10.0), ("r", 2, "b", 12.2), ("r", 3, "b", 14.0), ("r", 4, "a", 10.2), ("r", 5, "a", 1020.0), ("r", 6, "b", 1030.0), ("q", 7, "b", 11.0)]
    e = spark.createDataFrame(rows, "recording_id string, event_index long, type string, latency double")
    one = intervals.first_at_a_time(e.where("type = 'a'"))
    assert [r[0] for r in one.select("event_index").orderBy("event_index").collect()] == [1, 5]
    b = e.where("type = 'b'")
    got = {last: {r["event_index"]: r["found"] for r in intervals.event_in_epoch(one, b, 0, 11, last=last).collect()} for last in (False, True)}
    assert got[False] == {1: pytest.approx(2.2), 5: 10.0} and got[True] == {1: 4.0, 5: 10.0}
    assert {r["found"] for r in intervals.event_in_epoch(one, b.limit(0), 0, 11).collect()} == {None}


def test_events_in_crowded_epochs(spark):
    """Against brute force; then with so many events at a sample that pairs would be 900 million. An event without index is never found, as in SQL."""
    rng = np.random.default_rng(8)
    a = [("qr"[int(rng.integers(2))], i, "a", float(np.round(rng.uniform(1, 400), 1)), 0.0) for i in range(200)]
    b = [("qr"[int(rng.integers(2))], int(i), "b", float(np.round(rng.uniform(1, 400), 1)), float(i)) for i in rng.permutation(150)] + [("q", None, "b", float(t), -1.0) for t in range(1, 400, 9)]
    schema = "recording_id string, event_index long, type string, latency double, value double"
    ea, eb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for last, value, tile in ((False, "latency", 16), (True, "latency", 64), (False, "value", 16_384), (True, "value", 16)):
        got = {r["event_index"]: r["found"] for r in intervals.event_in_epoch(ea, eb, -5, 12, value, last, tile).collect()}
        for rec, i, _, t, _ in a:
            lat = np.floor(t + 0.5)
            inside = sorted((np.floor(o[3] + 0.5), o[1], o[3] - lat if value == "latency" else o[4]) for o in b if o[0] == rec and o[1] is not None and lat - 5 <= np.floor(o[3] + 0.5) <= lat + 6)
            assert got[i] == (pytest.approx(inside[-1 if last else 0][2]) if inside else None)
    many = spark.range(60_000).select(F.lit("r").alias("recording_id"), F.col("id").alias("event_index"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("type"), (F.col("id") % 50 + 1).cast("double").alias("latency"))
    found = intervals.event_in_epoch(many.where("type = 'a'"), many.where("type = 'b'"), 0, 100).groupBy("found").count().collect()
    assert {r["found"]: r["count"] for r in found} == {1.0: 30_000}


def test_middle_window_and_inserted_rows(model, spark):
    e, _, _, x = model
    w = plotdata.display_window(x, e, 1.0, 20)
    for r in w.groupBy("recording_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect():
        times = sorted(round(v[0]) for v in e.where(F.col("recording_id") == r["recording_id"]).select("latency").collect())
        mid = times[(len(times) + 1) // 2 - 1]
        assert mid - 10 < r["a"] <= r["b"] < mid + 10
    df = spark.createDataFrame([(i, f"x{i}") for i in range(1, 6)], "place int, v string")
    new = spark.createDataFrame([(2, "n"), (5, "m")], "after int, v string")
    assert [r["v"] for r in plotdata.insert_rows(df, new, "place", "after").orderBy("place").collect()] == ["x1", "x2", "n", "x3", "x4", "x5", "m"]


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.normal(size=3000), 2), np.full(500, 0.25)])
    ps = [0.0, 0.01, 0.3, 0.5, 0.777, 1.0]
    got = {r["p"]: r["q"] for r in stats.hazen(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", ps).collect()}
    s = np.sort(x)
    want = [np.interp(min(max(len(s) * p + 0.5, 1), len(s)), np.arange(1, len(s) + 1), s) for p in ps]
    assert [got[p] for p in ps] == pytest.approx(want)
    assert stats.hazen(spark.createDataFrame([], "x double"), "x", ps).count() == 0
