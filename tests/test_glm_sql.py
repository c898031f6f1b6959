import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelweave.functions import sql
from kernelweave.operators import expand, glm
from kernelweave.sources import simulate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    p = 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    return spark.createDataFrame([(*map(float, v), float(rng.random() < q), float(rng.poisson(np.exp(0.3 + 0.5 * v[0]))), float(1 + 3 * v[0]), i % 3) for i, (v, q) in enumerate(zip(x, p, strict=True))], "a double, b double, c double, y double, k double, g double, fold int").cache()


def test_families(rows):
    path = glm.glm_path(rows, ["a", "b", "c"], "y", "binomial", lambdas=[0.2, 0.0])
    assert path.coefs[0, 2] == 0 and path.at(0.0)[1] == pytest.approx(2, abs=0.4) and path.nonzero(0.2) == [c for c, v in zip("abc", path.coefs[0], strict=True) if v]
    score = rows.agg(*[F.sum(F.col(c) * (F.col("y") - path.predict(0.0, "response"))) for c in "abc"]).first()
    assert np.allclose(score, 0, atol=1e-4)  # the likelihood's slope is zero
    assert glm.losses(rows, path, 0.0, "y").first()["class_error"] < 0.25
    pois = glm.glm_path(rows, ["a"], "k", "poisson", lambdas=[0.0])
    assert pois.at(0.0)[1] == pytest.approx(0.5, abs=0.1)
    line = glm.glm_path(rows, ["a", "b"], "g", lambdas=[0.0])
    assert np.allclose(line.at(0.0), [1, 3, 0], atol=1e-6)
    for bad in (lambda: glm.glm_path(rows, ["a"], "y", "cox"), lambda: glm.glm_path(rows.limit(0), ["a"], "y"), lambda: line.predict(0.0, "class")):
        with pytest.raises(ValueError):
            bad()


def test_cv(rows):
    got = glm.glm_cv(rows, ["a", "c"], "g", "fold", lambdas=[1.0, 0.1, 0.0], loss="mse")
    assert got["lambda_min"] == 0 and got["lambda_1se"] >= 0
    with pytest.raises(ValueError):
        glm.glm_cv(rows.where("fold < 2"), ["a"], "g", "fold", lambdas=[0.0])


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("select x.* from values (5.4), (cast(null as double)) as e(latency), lateral time_expand(latency, -1, 3) x").collect()
    assert [tuple(r) for r in got] == [(4, -1), (5, 0), (6, 1)]
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(sql.custom_basis(F.col("x"), sql.polynomial, [0, 1])).collect()] == [[2.0, 4.0], None]


def test_custom_column_and_tutorials(spark):
    xdc = spark.createDataFrame([("r", 1, 0, 0, 1.0)], "recording_id string, t long, col_id int, basis_id int, v double")
    extra = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 0.0)], "recording_id string, t long, v double")
    assert expand.with_column(xdc, extra, 7).where("col_id = 7").count() == 1
    for kind in ("2x2", "trf", "erpimage"):
        s, e = simulate.tutorial(spark, kind, 12)
        assert s.count() == 240 * (2 if kind == "trf" else 1) and e.count() == 20
