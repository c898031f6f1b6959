import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.operators import expand, fit, intervals, plotdata, postfit
from kernelweave.operators.design import design
from kernelweave.sources import recordings, simulate


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i % 2}", i, "a" if i % 3 else "b", float(t), float(rng.normal()), float(rng.normal())) for i, t in enumerate(np.cumsum(rng.integers(2, 9, 150)))]
    e = spark.createDataFrame(rows, "recording_id string, event_index long, type string, latency double, u double, v double")
    s = simulate.superpose(e, {"a": {"1": 3.0, "u": 2.5, "v": -1.5}, "b": {"1": 1.0}}, simulate.kernel("hanning", 6), 1000, channels=2)
    d = design(e, ["y~1+u+v", "y~1"], [["a"], ["b"]])
    return e, s, d, expand.sticks(expand.single(d.long()), -2, 10, 1000)


@pytest.mark.parametrize("method", ["normal", "pinv", "lsmr"])
def test_overlap_is_recovered(model, method):
    _, s, _, x = model
    k = simulate.kernel("hanning", 6)
    kw = {"tol": 1e-13, "iterations": 3000} if method == "lsmr" else {}
    for r in fit.fit_overlap(x, s, method, **kw).collect():
        want = [3.0, 2.5, -1.5, 1.0][r["col_id"]] * (k[r["basis_id"] - 2] if 2 <= r["basis_id"] < 8 else 0)
        assert r["beta"] == pytest.approx(want, abs=1e-6)


def test_gram_by_tiles_is_gram_by_join(model):
    _, s, _, x = model
    stats = fit.statistics(x, s, tile=64)
    g = stats.total()[1]
    at = {k: i for i, k in enumerate(stats.keys)}
    got = {(at[r["col_a"], r["basis_a"]], at[r["col_b"], r["basis_b"]]): r["g"] for r in fit.gram_by_join(x).collect()}
    assert all(g[k] == pytest.approx(v) for k, v in got.items()) and np.count_nonzero(g) <= len(got)


def test_outlier_outside_of_windows_is_ignored(model):
    _, s, _, x = model
    far = s.withColumn("y", F.when(F.col("t") == 999, 1e10).otherwise(F.col("y")))
    beta = {(r["channel"], r["col_id"], r["basis_id"]): r["beta"] for r in fit.fit_overlap(x, far).collect()}
    assert beta[1, 0, 4] == pytest.approx(3.0 * simulate.kernel("hanning", 6)[2], abs=1e-5)


def test_first_stick_counts_events(model):
    e, _, _, x = model
    assert x.where("col_id = 0 and basis_id = 3").agg(F.sum("v")).first()[0] == e.where("type = 'a'").count()


def test_ties(spark):
    long = spark.createDataFrame([("r", 1, "a", 5.0, 0, 1.0), ("r", 2, "a", 5.2, 0, 4.0)], "recording_id string, event_index long, type string, latency double, col_id int, x double")
    assert expand.single(long).first()["x"] == 4 and expand.single(long, "sum").first()["x"] == 5


def test_bases():
    assert np.allclose(expand.time_basis("splines", 20, 8).sum(0), 1) and expand.time_basis("stick", 4).shape == (4, 4)
    f = expand.time_basis("fourier", 15, 4)
    assert f.shape[0] == 7 and np.allclose(f[1] @ f[3], 0) and expand.window((-0.5, 1.0), 10) == (-5, 15)
    with pytest.raises(ValueError):
        expand.time_basis("splines", 2)


def test_model_fit(model):
    e, s, d, x = model
    stats = fit.statistics(x, postfit.folds(s, e, n=3, method="equalEntries"), fold="fold")
    assert all(r[4] == pytest.approx(1) for r in postfit.model_fit(stats, d))
    partial = postfit.model_fit(stats, d, "partialR2")
    assert len(partial) == 8 and all(r[3] > 0 for r in partial) and len(postfit.model_fit(stats, d, "crossValpartialR2", ["u"])) == 6
    total = stats.total()
    assert np.allclose(sum(f[1] for f in stats.folds.values()), total[1])
    with pytest.raises(ValueError):
        postfit.model_fit(stats, d, "odd")


def test_prediction_and_marginals(model):
    e, s, d, x = model
    c = postfit.condense(fit.fit_overlap(x, s), np.eye(10), -2, 1.0)
    p = postfit.predict(c, d, {"u": [0.0, 1.0], "v": [2.0]})
    k = simulate.kernel("hanning", 6)
    one = {(r["variable"], r["value"]): r["beta"] for r in p.where("lag = 2 and channel = 1").collect()}
    assert one["u", 1.0] == pytest.approx(2.5 * k[2]) and one["u", 0.0] == pytest.approx(0, abs=1e-9) and one["v", 2.0] == pytest.approx(-3 * k[2])
    mean = {r["variable"]: r["m"] for r in [{"variable": v, "m": e.where("type = 'a'").agg(F.avg(v)).first()[0]} for v in "uv"]}
    m = {(r["variable"], r["value"]): r["beta"] for r in postfit.marginal(p, c, d).where("lag = 2 and channel = 1").collect()}
    assert m["u", 1.0] == pytest.approx((2.5 + 3.0 - 1.5 * mean["v"]) * k[2]) and m["2_(Intercept)", None] == pytest.approx(k[2])


def test_elastic_net():
    rng = np.random.default_rng(0)
    x, true = rng.normal(size=(400, 8)), np.array([2.0, 0, 0, -1, 0, 0, 0.5, 0])
    y = x @ true + 0.1 * rng.normal(size=400) + 3
    stats = [(len(p), x[p].T @ x[p], x[p].T @ y[p], x[p].sum(0), y[p].sum(), (y[p] ** 2).sum()) for p in np.array_split(rng.permutation(400), 5)]
    got = fit.cv_elastic_net(stats)
    assert np.allclose(got["beta"], true, atol=0.1) and np.abs(got["beta"][true == 0]).max() < 0.02 and got["intercept"] == pytest.approx(3, abs=0.05) and got["lambda_1se"] >= got["lambda_min"]
    lam, coefs, _ = fit.elastic_net(*stats[0][1:3], stats[0][0], *stats[0][3:], alpha=1.0)
    assert not coefs[0].any() and len(lam) == 100
    soft = fit.elastic_net(np.eye(2) * 100, np.array([50.0, 5.0]), 100, lambdas=np.array([0.1]), standardize=False, intercept=False)[1][0]
    assert np.allclose(soft, [0.4, 0.0])
    assert np.allclose(fit.at_lambda(lam, coefs, lam[3]), coefs[3])


def test_lagged_signal_recovers_kernels(spark):
    rng = np.random.default_rng(3)
    h, x = np.hanning(15), rng.normal(size=(2, 600))
    y = np.convolve(x[0], h)[:600] - 0.5 * np.convolve(x[1], h)[:600]
    s = recordings.read_signal(spark.createDataFrame([(i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, *x, strict=True))], "t long, y double, a double, b double"))
    xdc = expand.lagged(s, 2, -5, 25, 0).union(expand.lagged(s, 3, -5, 25, 1))
    beta = {(r["col_id"], r["basis_id"]): r["beta"] for r in fit.fit_overlap(xdc, s, channels=[1]).collect()}
    assert all(beta[0, 5 + i] == pytest.approx(h[i], abs=1e-4) and beta[1, 5 + i] == pytest.approx(-0.5 * h[i], abs=1e-4) for i in range(15))


def test_intervals(spark):
    rows = [(1, 5), (3, 8), (10, 15), (15, 20), (25, 30), (26, 27), (None, 3)]
    df = spark.createDataFrame([("r", a, b) for a, b in rows], "recording_id string, start_t long, end_t long")
    merged = [tuple(r)[1:] for r in intervals.merge(df).orderBy("start_t").collect()]
    assert merged == [(1, 8), (10, 20), (25, 30)]
    t = spark.range(1, 41).select(F.lit("r").alias("recording_id"), F.col("id").alias("t"))
    assert intervals.exclude(t, df, tile=7).count() == 40 - 8 - 11 - 6 and intervals.exclude(t, df.limit(0)).count() == 40
    assert [tuple(r)[1:] for r in intervals.runs(intervals.exclude(t, df)).orderBy("start_t").collect()] == [(9, 9), (21, 24), (31, 40)]


def test_amplitude_golden(spark):
    """Two spikes near each other and one alone at 10 Hz."""
    y = [1000.0 if t in (500, 505, 525) else 0.0 for t in range(1, 1001)]
    s = spark.createDataFrame([("r", i + 1, 1, v) for i, v in enumerate(y)], recordings.SAMPLES)
    for chunk in (100_000, 37):
        got = intervals.amplitude(s, 10.0, 150, 1000, 100, 200, [1], chunk=chunk)
        assert [tuple(r)[1:] for r in got.orderBy("start_t").collect()] == [(492, 513), (517, 533)]


def test_epochs_and_clean_events(spark):
    s = spark.createDataFrame([("r", t, 1, float(t)) for t in range(1, 101)], recordings.SAMPLES)
    e = spark.createDataFrame([("r", 1, "a", 50.4), ("r", 2, "a", 98.0), ("r", 3, "a", 20.0)], recordings.EVENTS)
    w = spark.createDataFrame([("r", 22, 30)], "recording_id string, start_t long, end_t long")
    got = intervals.epochs(e, s, -2, 6, w).orderBy("lag").collect()
    assert [r["y"] for r in got] == [48.0, 49, 50, 51, 52, 53] and {r["event_index"] for r in got} == {1}
    assert intervals.epochs(e.limit(0), s, -2, 6).count() == 0


def test_joint_probability_union(spark):
    rng = np.random.default_rng(1)
    rows = [("r", t, c, float(rng.normal() + (100 if 401 <= t <= 450 and c == 1 else 0))) for t in range(1, 2001) for c in (1, 2)]
    s = spark.createDataFrame(rows, recordings.SAMPLES)
    both = {tuple(r) for r in intervals.improbable(s, 10, 5).collect()}
    one = {tuple(r) for r in intervals.improbable(s, 10, 5, overall=1e9).collect()}
    two = {tuple(r) for r in intervals.improbable(s, 10, 5, local=1e9).collect()}
    assert one | two == both and ("r", 401, 450) in one
    assert ("r", 401, 450) in {tuple(r) for r in intervals.bursts(s, 10, 10, 5).collect()}


def test_scenarios(spark):
    for n in (1, 8, 15):
        s, e = simulate.scenario(spark, n, 20)
        assert s.count() == 200 and e.count() > 5
    with pytest.raises(ValueError):
        simulate.kernel("odd", 3)


def test_tables_for_plots(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, lag, float(lag), float(lag)) for lag in range(6)], "channel int, col_id int, lag int, time_s double, beta double")
    assert plotdata.baseline(c, 0.0, 2.0, ["channel"]).where("lag = 5").first()["beta"] == 4.5
    e = spark.createDataFrame([(float(v),) for v in range(41)], "x double")
    assert {r["bin"]: r["n"] for r in plotdata.histogram(e, "x").collect()}[19] == 3
    d = plotdata.density(e, "x").agg(F.sum("density")).first()[0] * 40 / 49
    assert 0.8 < d < 1.05
    i = plotdata.insert_rows(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([("n", 1)], "v string, after int"), "k", "after")
    assert [r["v"] for r in i.orderBy("k").collect()] == ["a", "n", "b"]
    old = spark.createDataFrame([(1.0, "x")], "dcBeta double, colname string")
    assert recordings.migrate(old, {"dcBeta": "beta", "colname": "name"}).columns == ["beta", "name"]
    recordings.write_csv(old, str(tmp_path / "out"))
    assert (tmp_path / "out.csv").is_dir()


def test_streams(spark, tmp_path):
    from kernelweave.streaming import online

    spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(10)], "k string, x double, y double").write.parquet(str(tmp_path / "in"))
    m = online.running_moments(spark.readStream.schema("k string, x double, y double").parquet(str(tmp_path / "in")), ["k"], "x", "y")
    q = m.writeStream.format("memory").queryName("moments").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = online.slope(spark.table("moments"), ["k"]).first()
    assert (r["slope"], r["intercept"]) == (2.0, 1.0)


def test_missing_values_are_named(model, spark):
    e, s, d, x = model
    holes = s.withColumn("y", F.when((F.col("channel") == 2) & (F.col("t") % 50 == 0), None).otherwise(F.col("y")))
    with pytest.raises(Exception, match="miss values in some channels"):
        fit.fit_overlap(x, holes).count()
    alone = {(r["col_id"], r["basis_id"]): r["beta"] for r in fit.fit_overlap(x, holes, channels=[1]).collect()}
    assert alone[0, 4] == pytest.approx(3.0 * simulate.kernel("hanning", 6)[2], abs=1e-6)
    gap = e.withColumn("u", F.when(F.col("event_index") % 7 == 0, None).otherwise(F.col("u")))
    with pytest.raises(Exception, match="misses a covariate"):
        expand.sticks(expand.single(design(gap, ["y~1+u"], [["a"]]).long()), -2, 10, 1000).count()
    with pytest.raises(ValueError, match="no formula has"):
        design(e, "y~1+u", ["a"], categorical={"grp": ["x", "y"]})


def test_partial_r2_is_the_difference(model):
    e, s, d, x = model
    stats = fit.statistics(x, s.withColumn("fold", F.lit(0)), fold="fold")
    keep = np.array([c != 1 for c, _ in stats.keys])
    n, gram, cross, total, squares, columns = stats.total()
    beta = np.linalg.pinv(gram[np.ix_(keep, keep)]) @ cross[keep]
    rss = squares - 2 * (beta * cross[keep]).sum(0) + np.einsum("pc,pq,qc->c", beta, gram[np.ix_(keep, keep)], beta)
    got = {(r[1], r[2]): r[3] for r in postfit.model_fit(stats, d, "partialR2", ["u"])}
    assert got[1, "u"] == pytest.approx(1 - (1 - rss[0] / (squares[0] - total[0] ** 2 / n)), abs=1e-8)
    dense = x.groupBy("col_id", "basis_id").agg(F.sum("v").alias("v")).collect()
    at = {k: i for i, k in enumerate(stats.keys)}
    assert all(columns[at[r["col_id"], r["basis_id"]]] == pytest.approx(r["v"]) for r in dense)


def test_folds_of_equal_numbers_of_modelled_samples(model, spark):
    e, s, _, x = model
    got = postfit.folds(s.where("channel = 1"), e, n=4, method="equalEntries", modelled=x)
    rows = got.join(x.select("recording_id", "t").distinct(), ["recording_id", "t"], "left_semi").groupBy("recording_id", "fold").count().collect()
    assert len(rows) == 8 and all(abs(r["count"] - sum(q["count"] for q in rows if q["recording_id"] == r["recording_id"]) / 4) <= 1 for r in rows)
    assert got.count() == s.where("channel = 1").count()
    with pytest.raises(ValueError, match="modelled samples"):
        postfit.folds(s, e, "a", modelled=x, allow_overlap=False)
    assert postfit.folds(s, e, ["a", "b"]).select("fold").distinct().count() > 50


def test_epochs_of_events_at_one_sample(spark):
    """Events that share samples, one without an index, a window that is excluded and one that hangs over the end."""
    rng = np.random.default_rng(3)
    rows = [("r", i or None, "a", float(5 + 7 * (i % 3)), float(rng.normal())) for i in range(300)] + [("r", 900, "a", 40.0, 1.0), ("r", 901, "a", 49.0, 1.0), ("r", 902, "b", 12.0, 9.0)]
    events = spark.createDataFrame(rows, "recording_id string, event_index long, type string, latency double, x double")
    y = rng.normal(size=(51, 2))
    samples = spark.createDataFrame([("r", t, c + 1, float(y[t, c])) for t in range(1, 51) for c in range(2)], "recording_id string, t long, channel int, y double")
    gone = spark.createDataFrame([("r", 41, 41)], "recording_id string, start_t long, end_t long")
    got = {(r["channel"], r["col_id"], r["lag"]): r["beta"] for r in fit.fit_epochs(design(events, "y ~ 1 + x", ["a"]), samples, -1, 4, exclude=gone).collect()}
    x = np.array([[1.0, r[4]] for r in rows[:300]])
    for lag in range(-1, 3):
        want = np.linalg.lstsq(x, np.array([y[int(r[3]) + lag] for r in rows[:300]]), rcond=None)[0]
        assert all(got[c + 1, j, lag] == pytest.approx(want[j, c], abs=1e-9) for c in range(2) for j in range(2))
    assert len(got) == 16
