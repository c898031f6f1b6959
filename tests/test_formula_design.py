import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import splines as sp
from kernelweave.functions import stats
from kernelweave.operators.design import design, impute, rank
from kernelweave.plans.formula import FormulaError, number, parse


@pytest.fixture(scope="module")
def events(spark):
    rows = [("r", i, "a" if i % 2 else "b", float(i + 1), "ABC"[i % 3], float(i % 3 + 1), float(i), float(i % 2), i % 4 == 0) for i in range(24)]
    return spark.createDataFrame(rows, "recording_id string, event_index long, type string, latency double, catA string, catB double, x double, cond double, flag boolean").withColumn("flag", F.col("flag").cast("double"))


def test_parse():
    f = parse("y ~ 1 + cat(b) * a + spl(s, 5) + circspl(c, 15, 0, 2*pi)")
    assert f.terms == [("a",), ("b",), ("a", "b")] and f.categorical == {"b"} and [s.n for s in f.splines] == [5, 15]
    assert parse("y~conditionB*conditionA:continuousA").terms[-1] == ("conditionA", "conditionB", "continuousA")
    assert not parse("y~-1+x").intercept and number("2*pi") == pytest.approx(2 * np.pi)
    for bad in ("y", "y~spl(a,5)*b", "y~b:spl(a,5)", "y~foo(a)", "y ~", "y~spl(a,import os)"):
        with pytest.raises(FormulaError):
            parse(bad)


def test_names_and_order(events):
    both = [{"catA": ["B", "C", "A"], "catB": [2.0, 3.0, 1.0]}, {"catB": [2.0, 3.0, 1.0]}]
    assert design(events, "y~1+cat(catA)+cat(catB)", ["a", "b"], categorical=both[0]).names == ["(Intercept)", "catA_C", "catA_A", "catB_3", "catB_1"]
    assert design(events, "y~1+cat(catA)+cat(catB)", ["a", "b"], categorical=both[1]).names == ["(Intercept)", "catA_B", "catA_C", "catB_3", "catB_1"]
    assert design(events, "y~1+catB+cat(catA)", ["a", "b"]).names == ["(Intercept)", "catA_B", "catA_C", "catB"]
    two = design(events, ["y~x", "y~x+catB"], [["a"], ["b"]])
    assert two.names == ["(Intercept)", "x", "2_(Intercept)", "catB", "2_x"]
    assert len(design(events, "y~cat(catA)*cat(catB)", ["a", "b"], coding="reference").names) == 9


def test_values(events):
    d = design(events, "y~1+cat(catA)", ["a", "b"], coding="effects")
    sums = d.long().groupBy("col_id").agg(F.sum("x").alias("s")).orderBy("col_id").collect()
    assert [r["s"] for r in sums] == [24, 0, 0]
    full = design(events, "y~1+cat(catA)", ["a", "b"], coding="full")
    assert rank(full) == (3, 4) and rank(design(events, "y~1+x", ["a", "b"])) == (2, 2)


def test_guards(events):
    for call in (lambda: design(events, "y~nope", ["a"]), lambda: design(events, "y~x", ["zz"]), lambda: design(events, "y~cat(catA)", ["a"], categorical={"catA": ["A", "Z"]}), lambda: design(events, "y~x", ["a"], coding="odd"), lambda: design(events.withColumn("type", F.lit("")), "y~x", ["a"]), lambda: design(events.withColumn("x", F.lit(1.0)), "y~x", ["a"])):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("kind,knots,bounds", [("default", np.array([0.0, 3, 7, 10]), None), ("circular", np.linspace(0, 24, 7), (0.0, 24.0))])
def test_spline_columns_are_the_basis(spark, kind, knots, bounds):
    x = np.linspace(0, 10, 41) if kind == "default" else np.linspace(-5, 40, 41)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array(df.select(*sp.columns(F.col("x"), kind, knots, bounds)).collect())
    want = sp.cubic_values(x, knots) if kind == "default" else sp.circular_values(x, knots, bounds)
    assert np.allclose(got, want) and np.allclose(got.sum(1), 1)
    assert spark.createDataFrame([(None,)], "x double").select(*sp.columns(F.col("x"), kind, knots, bounds)).first()[0] is None


def test_splines_recover_curves(spark):
    x = np.linspace(-10, 10, 100)
    e = spark.createDataFrame([("r", i, "a", float(i + 1), float(v)) for i, v in enumerate(x)], "recording_id string, event_index long, type string, latency double, s double")
    d = design(e, "y~1+spl(s,10)", ["a"])
    wide = d.wide().orderBy("event_index").toPandas()[d.names].to_numpy()
    assert len(d.names) == 10
    fit = wide @ np.linalg.lstsq(wide, x**2, rcond=None)[0]
    assert ((fit - x**2) ** 2).sum() < 1e-3
    a, b = np.meshgrid(np.linspace(-10, 10, 12), np.linspace(-10, 10, 12))
    e = spark.createDataFrame([("r", i, "a", float(i + 1), float(u), float(v)) for i, (u, v) in enumerate(zip(a.ravel(), b.ravel(), strict=True))], "recording_id string, event_index long, type string, latency double, u double, v double")
    d = design(e, "y~1+2dspl(u,v,4)", ["a"], spacing="linear")
    wide = d.wide().orderBy("event_index").toPandas()[d.names].to_numpy()
    y = a.ravel() ** 2 + 0.05 * b.ravel() ** 3
    assert wide.shape[1] == 16 and ((wide @ np.linalg.lstsq(wide, y, rcond=None)[0] - y) ** 2).sum() < 2e-3


def test_impute(spark, events):
    long = design(events.withColumn("x", F.when(F.col("event_index") != 5, F.col("x"))), "y~1+x", ["a", "b"]).long()
    mean = [r["x"] for r in impute(long, "mean").where("event_index = 5 and col_id = 1").collect()]
    assert mean == [pytest.approx(np.mean([i for i in range(24) if i != 5]))]
    assert impute(long, "drop").count() == 46 and impute(long, "median").where("x is null").count() == 0
    drawn = impute(long, "marginal")
    assert drawn.count() == 48 and drawn.where("x is null").count() == 0
    with pytest.raises(ValueError):
        impute(long, "odd")


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8)] + [("b", 3.0), ("b", None)], "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in stats.hazen(df, "v", [0.0, 0.25, 0.5, 1.0], ["g"]).collect()}
    assert got[("a", 0.25)] == 1.5 and got[("a", 0.0)] == 1 and got[("a", 1.0)] == 8 and got[("b", 0.5)] == 3
    assert stats.trimmed_mean(df, "v", ["g"], 50).where("g = 'a'").first()["trimmed"] == 3
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-5) and stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    v = {r["column"]: r["vif"] for r in stats.vif(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert np.allclose([v[c] for c in "abc"], np.diag(np.linalg.inv(np.corrcoef(x.T))))
