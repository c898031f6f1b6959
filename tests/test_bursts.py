import numpy as np
import pandas as pd
import pytest

from kernelweave.operators import bursts, intervals


def signal(spark, rec, n=3000, c=8, seed=0, burst=None, loud=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, c))
    if burst:
        a, b = burst
        x[a - 1 : b] += 1.4 * rng.normal(size=(b - a + 1, 1))  # one source in all channels alike
    if loud:
        a, b = loud
        x[a - 1 : b, 2] *= 30
    return pd.DataFrame({"recording_id": rec, "t": np.repeat(np.arange(1, n + 1), c), "channel": np.tile(np.arange(1, c + 1), n), "y": x.ravel()})


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(pd.concat([signal(spark, "shared", burst=(1201, 1300)), signal(spark, "clean", seed=1), signal(spark, "loud", seed=2, loud=(501, 540))]))


def test_shared_burst_that_no_channel_shows(samples):
    got = bursts.repaired(samples, 100.0, cutoff=12.0).toPandas()
    assert set(got["recording_id"]) == {"shared", "loud"}
    marked = lambda rec: {t for r in got[got["recording_id"] == rec].itertuples() for t in range(r.start_t, r.end_t + 1)}
    assert set(range(1201, 1301)) <= marked("shared") and marked("shared") <= set(range(1150, 1351))
    assert set(range(501, 541)) <= marked("loud") and marked("loud") <= set(range(450, 601))
    alone = intervals.bursts(samples, 100.0, cutoff=12.0).toPandas()
    assert "shared" not in set(alone["recording_id"])  # each channel's amplitude stays in range


def test_windows_and_centre(spark, samples):
    one = samples.where("recording_id = 'clean'")
    got = bursts.windows(one, list(range(1, 9)), 50).toPandas().sort_values("window")
    x = one.toPandas().pivot(index="t", columns="channel", values="y").to_numpy()
    assert got["window"].tolist() == list(range(119))  # halves of 25 samples, whole windows only
    for i in (0, 63, 64, 118):
        w = x[i * 25 : i * 25 + 50]
        assert np.allclose(np.frombuffer(got["v"].iloc[i]).reshape(8, 8), w.T @ w / 50)
    table = spark.createDataFrame([("r", np.array([v]).tobytes()) for v in [1.0, 2.0, 3.0, 2.5, 900.0]], "recording_id string, v binary")
    assert np.frombuffer(bursts.centre(table, 1, 60).first()["m"])[0] == pytest.approx(2.5, abs=0.01)


def test_gaps_eyes_and_nothing(samples):
    few = samples.where("recording_id = 'loud' and not (t between 300 and 305)")
    got = bursts.repaired(few, 100.0, cutoff=12.0)
    assert got.count() >= 1 and bursts.repaired(samples.limit(0), 100.0).count() == 0
    assert bursts.repaired(samples.where("t < 20"), 100.0).count() == 0
    with pytest.raises(ValueError, match="eye"):
        bursts.repaired(samples, 100.0, labels={3: "Eye-L"})
