"""Packed sums of large models, and fits from them."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.operators import fit, packed, postfit


def rows(spark, p, n, per, seed=1):
    """n samples, `per` entries each over p columns; two channels."""
    rng = np.random.default_rng(seed)
    t = np.repeat(np.arange(1, n + 1), per)
    k = rng.integers(0, p, n * per)
    xs = {}
    for a, b in zip(t.tolist(), k.tolist(), strict=True):
        xs[a, b] = float(rng.normal())
    xdc = spark.createDataFrame([("r", a, b // 100, b % 100, v) for (a, b), v in xs.items()], "recording_id string, t long, col_id int, basis_id int, v double")
    y = rng.normal(size=(n, 2))
    s = spark.createDataFrame([("r", i + 1, c + 1, float(y[i, c]), int(i % 3)) for i in range(n) for c in range(2)], "recording_id string, t long, channel int, y double, fold int")
    dense = np.zeros((n, p))
    for (a, b), v in xs.items():
        dense[a - 1, b] = v
    return xdc, s, dense, y


@pytest.mark.parametrize("block", [7, 256])
def test_blocks_are_the_products(spark, monkeypatch, block):
    monkeypatch.setattr(fit, "BLOCK", block)
    # workers import the module anew; the size reaches them with the function
    xdc, s, dense, y = rows(spark, 60, 300, 4)
    if block != 256:
        real = fit._cells
        source = real.__globals__
        monkeypatch.setitem(source, "BLOCK", block)
    st = fit.statistics(xdc, s, fold="fold", tile=64)
    used = dense.any(1)
    keep = [c * 100 + b for c, b in st.keys]
    for f, (n, gram, cross, total, squares, columns) in st.folds.items():
        at = used & (np.arange(300) % 3 == f)
        x, yy = dense[at][:, keep], y[at]
        assert n == at.sum() and np.allclose(gram, x.T @ x) and np.allclose(cross, x.T @ yy) and np.allclose(columns, x.sum(0))
        assert np.allclose(total, yy.sum(0)) and np.allclose(squares, (yy * yy).sum(0))


def test_five_thousand_columns(spark):
    xdc, s, dense, y = rows(spark, 5000, 4000, 3)
    tracemalloc.start()
    st = fit.statistics(xdc, s)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    p = len(st.keys)
    keep = [c * 100 + b for c, b in st.keys]
    assert p > 4500 and most < 1.5e9
    _, gram, cross, *_ = st.total()
    x = dense[:, keep]
    assert np.allclose(gram, x.T @ x) and np.allclose(cross, x.T @ y)


def test_summed(spark):
    df = spark.createDataFrame([(k, np.full(3, float(i)).tobytes()) for i in range(20) for k in ("a", "b")], "k string, v binary").repartition(5)
    got = {r["k"]: np.frombuffer(r["v"]) for r in packed.summed(df, "k").collect()}
    assert np.allclose(got["a"], 190) and np.allclose(got["b"], 190) and packed.summed(df.limit(0), "k").count() == 0


def test_blocks_in_order(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_BYTES", 64 * 8)
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("id"))
    got = packed.blocks(df, {"x": [F.col("id")], "two": [F.col("id") * 2, F.lit(1)]}, [F.col("id")]).orderBy("block").collect()
    assert np.allclose(np.concatenate([np.frombuffer(r["x"]) for r in got]), np.arange(500)) and max(r["n"] for r in got) <= 64
    assert np.allclose(np.frombuffer(got[0]["two"]).reshape(-1, 2)[:, 1], 1)


def test_a_signal_without_variance_has_no_r2(spark):
    stats = (4, np.array([[4.0]]), np.array([[8.0, 3.0]]), np.array([8.0, 3.0]), np.array([16.0, 9.0]), np.array([4.0]))
    r = postfit._r2(np.array([[2.0, 0.75]]), stats)
    assert np.isnan(r[0]) and r[1] == pytest.approx(0)
