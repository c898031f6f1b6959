import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import stats
from kernelweave.operators import design as dm
from kernelweave.operators import packed, tsqr


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=600), rng.normal(size=600)
    return spark.createDataFrame([(float(x), float(y), float(x + 1e-9 * z)) for x, y, z in zip(a, b, rng.normal(size=600), strict=True)], "a double, b double, c double").repartition(7)


def test_nearly_equal_columns_have_full_rank(near, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_BYTES", 64 * 8 * 3)
    r = tsqr.r_factor(near, [F.col(c) for c in "abc"])
    x = np.array(near.select("a", "b", "c").collect())
    assert np.allclose(np.abs(np.linalg.qr(x, mode="r")), np.abs(r), atol=1e-8) and tsqr.rank(r) == 3
    products = stats.moments(near, ["a", "b", "c"])[2] * 600
    assert np.linalg.matrix_rank(products) == 2  # what the squared condition number makes of it
    twice = tsqr.r_factor(near, [F.col("a"), F.col("b"), F.col("a") + F.col("b")])
    assert tsqr.rank(twice) == 2 and tsqr.rank(tsqr.r_factor(near.limit(0), [F.col("a")])) == 0
    assert tsqr.rank(tsqr.r_factor(near.limit(2), [F.col(c) for c in "abc"])) == 2


def test_inflation(spark, near):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) + 100
    x[:, 3] = x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    got = {r["column"]: r["vif"] for r in stats.vif(df, ["a", "b", "c", "d"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert np.allclose([got[c] for c in "abcd"], want, rtol=1e-8)
    whole = {r["column"]: r["vif"] for r in stats.vif(df.withColumn("s", F.col("a") - F.col("c")), ["a", "b", "c", "s"]).collect()}
    assert np.isinf(whole["a"]) and np.isinf(whole["c"]) and np.isinf(whole["s"]) and whole["b"] < 2
    assert {r["column"]: r["vif"] for r in stats.vif(near, ["a", "c"]).collect()}["a"] > 1e17


def test_design_warns(spark):
    ev = spark.createDataFrame([("r", i, "x", float(i), float(i % 7), float(2 * (i % 7))) for i in range(40)], "recording_id string, event_index long, type string, latency double, u double, v double")
    with pytest.warns(UserWarning, match="3 columns and rank 2"):
        dm.design(ev, "y ~ 1 + u + v", ["x"], check_rank=True)
    assert dm.rank(dm.design(ev, "y ~ 1 + u", ["x"])) == (2, 2)


def test_levels_have_a_limit(spark, monkeypatch):
    monkeypatch.setattr(dm, "MAX_LEVELS", 5)
    ev = spark.createDataFrame([("r", i, "x", float(i), f"id{i}") for i in range(9)], "recording_id string, event_index long, type string, latency double, u string")
    with pytest.raises(ValueError, match="no factor"):
        dm.design(ev, "y ~ 1 + u", ["x"])
