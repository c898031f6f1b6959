"""Registered queries on the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions import stats
from kernelweave.operators import expand, fit, intervals, plotdata, postfit
from kernelweave.operators.design import design, impute
from kernelweave.sources import recordings as src
from kernelweave.sources import simulate

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"
EV = f"""ev AS (SELECT 'r' || (user_id % 4) AS recording_id, event_id AS event_index, event_type AS type, {US} / 6e7 + 1 AS latency,
 value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ({US} / 3.6e9) % 24 AS hour, CAST(user_id % 3 AS DOUBLE) AS grp FROM events)"""
#: whole latencies, the last event of a type at a sample
ONE = f"{EV}, lat AS (SELECT *, CAST(round(latency) AS BIGINT) AS l FROM ev), one AS (SELECT recording_id, type, l, arg_max(value, event_index) AS value, arg_max(k, event_index) AS k FROM lat GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY recording_id, type, l")
SIG = f"""{EV}, lat AS (SELECT *, CAST(round(latency) AS BIGINT) AS l FROM ev), sig AS (
 SELECT r.recording_id, t.t, coalesce(n, 0.0) AS n, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT recording_id FROM ev) r CROSS JOIN (SELECT unnest(range(1, 43201)) AS t) t
 LEFT JOIN (SELECT recording_id, l, CAST(count(*) AS DOUBLE) AS n, sum(value) AS v FROM lat GROUP BY recording_id, l) s ON s.recording_id = r.recording_id AND s.l = t.t),
 samples AS (SELECT recording_id, t, 1 AS channel, n AS y FROM sig UNION ALL SELECT recording_id, t, 2, v FROM sig)"""
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, places: int = 6):
    return (F.round(F.col(c), places) + F.lit(0.0)).alias(c)


def _lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = src.table(spark, sf_dir, "lineitem")
    return src.read_events(li.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", F.lit("item").alias("type"), F.lit(1.0).alias("latency"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i")), "type", "latency", "i")


def _summary(long: DataFrame, metadata: DataFrame) -> DataFrame:
    s = long.groupBy("col_id").agg(F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("sum_x"), F.round(F.sum(F.col("x") * F.col("x")), 4).alias("sum_xx"))
    return s.join(metadata.select("col_id", "name"), "col_id").select("name", "n", (F.col("sum_x") + 0.0).alias("sum_x"), "sum_xx")


# ---- sources


@query(f"WITH {EV} SELECT recording_id, event_index, type, round(latency, 6) AS latency, value, k, round(hour, 6) AS hour, grp FROM ev")
def model_events(spark, sf_dir):
    return src.model_events(spark, sf_dir).select("recording_id", "event_index", "type", _r("latency"), "value", "k", _r("hour"), "grp")


@query(f"WITH {SIG} SELECT recording_id, channel, count(*) AS n, round(sum(y), 4) AS sum_y, max(y) AS max_y FROM samples GROUP BY recording_id, channel")
def signal_samples(spark, sf_dir):
    s = src.activity(spark, sf_dir)
    return s.groupBy("recording_id", "channel").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("sum_y"), F.max("y").alias("max_y"))


# ---- designs

_CODED = """SELECT '(Intercept)' AS name, count(*) AS n, CAST(count(*) AS DOUBLE) AS sum_x, CAST(count(*) AS DOUBLE) AS sum_xx FROM lineitem"""


def _col(name: str, expr: str, table: str = "lineitem") -> str:
    return f"SELECT '{name}' AS name, count({expr}) AS n, round(sum(CAST({expr} AS DOUBLE)), 4) AS sum_x, round(sum(CAST({expr} AS DOUBLE) * ({expr})), 4) AS sum_xx FROM {table}"


def _eq(c: str, v: str, other: int = 0, base: str | None = None) -> str:
    return f"(CASE WHEN {c} = '{v}' THEN 1.0" + (f" WHEN {c} = '{base}' THEN -1.0" if base else "") + " ELSE 0.0 END)"


@query(" UNION ALL ".join([_CODED, _col("l_linestatus_O", _eq("l_linestatus", "O")), _col("l_returnflag_N", _eq("l_returnflag", "N")), _col("l_returnflag_R", _eq("l_returnflag", "R")), _col("l_quantity", "l_quantity"), _col("l_linestatus_O:l_returnflag_N", f"{_eq('l_linestatus', 'O')} * {_eq('l_returnflag', 'N')}"), _col("l_linestatus_O:l_returnflag_R", f"{_eq('l_linestatus', 'O')} * {_eq('l_returnflag', 'R')}")]))
def design_reference(spark, sf_dir):
    d = design(_lineitems(spark, sf_dir), "y ~ 1 + cat(l_returnflag) * cat(l_linestatus) + l_quantity", ["item"])
    return _summary(d.long(), d.metadata())


@query(" UNION ALL ".join([_CODED, _col("l_linestatus_F", _eq("l_linestatus", "F", base="O")), _col("l_returnflag_A", _eq("l_returnflag", "A", base="R")), _col("l_returnflag_N", _eq("l_returnflag", "N", base="R"))]))
def design_effects(spark, sf_dir):
    d = design(_lineitems(spark, sf_dir), "y ~ 1 + cat(l_returnflag) + cat(l_linestatus)", ["item"], coding="effects")
    return _summary(d.long(), d.metadata())


@query(" UNION ALL ".join([_CODED, *[_col(f"l_returnflag_{v}", _eq("l_returnflag", v)) for v in "NRA"]]))
def design_full(spark, sf_dir):
    d = design(_lineitems(spark, sf_dir), "y ~ 1 + cat(l_returnflag)", ["item"], coding="full", categorical={"l_returnflag": ["N", "R", "A"]})
    return _summary(d.long(), d.metadata())


@query(f"""WITH {EV} SELECT name, count(*) AS n, round(sum(x), 4) AS sum_x, round(sum(x * x), 4) AS sum_xx FROM (
 SELECT '(Intercept)' AS name, 1.0 AS x FROM ev WHERE type IN ('click', 'view') UNION ALL SELECT 'value', value FROM ev WHERE type IN ('click', 'view')
 UNION ALL SELECT '2_(Intercept)', 1.0 FROM ev WHERE type = 'error' UNION ALL SELECT '2_value', value FROM ev WHERE type = 'error' UNION ALL SELECT 'k', k FROM ev WHERE type = 'error') GROUP BY name""")
def design_two_formulas(spark, sf_dir):
    d = design(src.model_events(spark, sf_dir), ["y ~ 1 + value", "y ~ 1 + value + k"], [["click", "view"], ["error"]])
    return _summary(d.long(), d.metadata())


def _hat(x: str, knots: list[str], i: int) -> str:
    """SQL of the i-th cubic B-spline over knots (SQL expressions), by de Boor's recursion."""
    t = [knots[0]] * 3 + knots + [knots[-1]] * 3
    last = len(knots) + 1

    def b(j: int, k: int) -> str:
        if k == 0:
            if t[j] == t[j + 1]:
                return "0.0"
            return f"(CASE WHEN {x} >= {t[j]} AND {x} {'<=' if j == last else '<'} {t[j + 1]} THEN 1.0 ELSE 0.0 END)"
        out = []
        if t[j] != t[j + k]:
            out.append(f"(({x} - {t[j]}) / ({t[j + k]} - {t[j]}) * {b(j, k - 1)})")
        if t[j + 1] != t[j + k + 1]:
            out.append(f"(({t[j + k + 1]} - {x}) / ({t[j + k + 1]} - {t[j + 1]}) * {b(j + 1, k - 1)})")
        return "(" + " + ".join(out) + ")" if out else "0.0"

    return b(i, 3)


@query("WITH " + EV + ", ks AS (SELECT 0.0::DOUBLE AS a, 50.0::DOUBLE AS b, 99.0::DOUBLE AS c) " + " UNION ALL ".join(f"SELECT {i} AS function, round(sum({_hat('k', ['a', 'b', 'c'], i)}), 4) AS total FROM ev, ks" for i in range(5)))
def spline_basis(spark, sf_dir):
    from kernelweave.functions import splines

    cols = splines.columns(F.col("k"), "default", np.array([0.0, 50.0, 99.0]))
    e = src.model_events(spark, sf_dir).agg(*[F.round(F.sum(c), 4).alias(str(i)) for i, c in enumerate(cols)])
    return e.select(F.inline(F.array(*[F.struct(F.lit(i).alias("function"), (F.col(str(i)) + 0.0).alias("total")) for i in range(len(cols))])))


@query(f"WITH {EV} SELECT type, count(*) AS n, round(sum(CAST(1.0 AS DOUBLE)), 4) AS unity FROM ev GROUP BY type")
def spline_unity(spark, sf_dir):
    """Circular and straight bases add up to one at every event."""
    from kernelweave.functions import splines

    round_ = splines.columns(F.col("hour"), "circular", np.linspace(0, 24, 7), (0.0, 24.0))
    flat = splines.columns(F.col("k"), "default", np.linspace(0, 99, 5))
    total = sum(round_, F.lit(0.0)) * sum(flat, F.lit(0.0))
    return src.model_events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), (F.round(F.sum(total), 4) + 0.0).alias("unity"))


@query()
def design_splines(spark, sf_dir):
    d = design(src.model_events(spark, sf_dir), "y ~ 1 + spl(value, 5) + circspl(hour, 6, 0, 24) + 2dspl(value, k, 4)", TYPES)
    return _summary(d.long(), d.metadata())


_HAZEN = """(SELECT CASE WHEN len(s) = 0 THEN NULL ELSE s[CAST(floor(r) AS BIGINT)] + (s[CAST(ceil(r) AS BIGINT)] - s[CAST(floor(r) AS BIGINT)]) * (r - floor(r)) END
 FROM (SELECT s, greatest(1.0, least(CAST(len(s) AS DOUBLE), len(s) * {p} + 0.5)) AS r))"""


@query(f"WITH {EV}, g AS (SELECT type, list_sort(list(value)) AS s FROM ev GROUP BY type), p AS (SELECT unnest([0.05, 0.25, 0.5, 0.95]::DOUBLE[]) AS p), c AS (SELECT type, p, s, greatest(1.0, least(CAST(len(s) AS DOUBLE), len(s) * p + 0.5)) AS r FROM g, p) SELECT type, p, round(s[CAST(floor(r) AS BIGINT)] + (s[CAST(ceil(r) AS BIGINT)] - s[CAST(floor(r) AS BIGINT)]) * (r - floor(r)), 6) AS q FROM c")
def hazen_quantiles(spark, sf_dir):
    return stats.hazen(src.model_events(spark, sf_dir), "value", [0.05, 0.25, 0.5, 0.95], ["type"]).select("type", "p", _r("q"))


def _gappy(spark, sf_dir):
    e = src.model_events(spark, sf_dir).withColumn("value", F.when(F.col("event_index") % 7 != 0, F.col("value")))
    return design(e, "y ~ 1 + value + k", TYPES).long()


_GAPPY = EV + ", gap AS (SELECT *, CASE WHEN event_index % 7 <> 0 THEN value END AS g FROM ev)"


@query(f"WITH {_GAPPY} SELECT type, round(sum(coalesce(g, (SELECT avg(g) FROM gap))), 4) AS total, count(*) AS n FROM gap GROUP BY type")
def impute_mean(spark, sf_dir):
    x = impute(_gappy(spark, sf_dir).where("col_id = 2"), "mean")
    return x.groupBy("type").agg(F.round(F.sum("x"), 4).alias("total"), F.count("x").alias("n"))


@query(f"WITH {_GAPPY} SELECT type, round(sum(coalesce(g, (SELECT median(g) FROM gap))), 4) AS total, count(*) AS n FROM gap GROUP BY type")
def impute_median(spark, sf_dir):
    x = impute(_gappy(spark, sf_dir).where("col_id = 2"), "median")
    return x.groupBy("type").agg(F.round(F.sum("x"), 4).alias("total"), F.count("x").alias("n"))


@query(f"WITH {_GAPPY} SELECT type, count(*) * 3 AS n FROM gap WHERE g IS NOT NULL GROUP BY type")
def impute_drop(spark, sf_dir):
    return impute(_gappy(spark, sf_dir), "drop").groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT type, c AS col_id, count(*) AS n FROM ev, (SELECT unnest([0, 1, 2]) AS c) GROUP BY type, c")
def impute_marginal(spark, sf_dir):
    x = impute(_gappy(spark, sf_dir), "marginal")
    return x.groupBy("type", "col_id").agg(F.count("x").alias("n"))


@query("SELECT c AS \"column\", round(1 / (1 - power((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 2)), 5) AS vif FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS c)")
def vif_two(spark, sf_dir):
    return stats.vif(src.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", _r("vif", 5))


@query()
def vif_embedding(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(size)]
    return stats.vif(e.select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names).select("column", _r("vif", 4))


@query(f"""WITH {EV}, g AS (SELECT *, lead(latency) OVER w - latency AS next_gap, latency - lag(latency) OVER w AS previous_gap FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY event_index)),
 f AS (SELECT * FROM g WHERE next_gap IS NOT NULL AND previous_gap IS NOT NULL) """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM f" for a in ("value", "k", "next_gap", "previous_gap") for b in ("value", "k", "next_gap", "previous_gap")))  # fmt: skip
def event_correlation(spark, sf_dir):
    g = expand.gaps(src.model_events(spark, sf_dir))
    return stats.correlation(g, ["value", "k", "next_gap", "previous_gap"]).select("a", "b", _r("r", 5))


@query(f"WITH {EV}, s AS (SELECT min(value) AS a, max(value) AS b FROM ev) SELECT CAST(least(floor((value - a) / (b - a) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM ev, s GROUP BY 1")
def event_histogram(spark, sf_dir):
    return plotdata.histogram(src.model_events(spark, sf_dir), "value")


@query(f"""WITH {EV}, s AS (SELECT min(value) AS a, max(value) AS b, 1.06 * stddev_samp(value) * power(count(*), -0.2) AS h, count(*) AS n FROM ev WHERE value IS NOT NULL),
 cells AS (SELECT floor((value - a) / (b - a) * 400) AS cell, avg(value) AS c, count(*) AS w FROM ev, s WHERE value IS NOT NULL GROUP BY 1), points AS (SELECT a + (b - a) * p / 49 AS x, h, n FROM s, (SELECT unnest(range(0, 50)) AS p))
 SELECT round(x, 6) AS x, round(sum(w * exp(-power((x - c) / h, 2) / 2) / (h * sqrt(2 * pi()))) / n, 6) AS density FROM points, cells GROUP BY x, n""")
def event_density(spark, sf_dir):
    return plotdata.density(src.model_events(spark, sf_dir), "value").select(_r("x"), _r("density"))


# ---- expansion


def _typed(spark, sf_dir, formula="y ~ 1"):
    return design(src.model_events(spark, sf_dir), [formula] * len(TYPES), [[t] for t in TYPES])


def _xdc(spark, sf_dir, width=20, lo=-5, formula="y ~ 1"):
    d = _typed(spark, sf_dir, formula)
    return d, expand.sticks(expand.single(d.long()), lo, width, src.N_SAMPLES)


_XDC = f"WITH {ONE}, xdc AS (SELECT recording_id, (CASE type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS col_id, b AS basis_id, l + b - 5 AS t, 1.0::DOUBLE AS v FROM one, (SELECT unnest(range(0, 20)) AS b) WHERE l + b - 5 BETWEEN 1 AND 43200)"


@query(f"{_XDC} SELECT col_id, CAST(basis_id AS INTEGER) AS basis_id, count(*) AS n, round(sum(v), 4) AS total, CAST(sum(t) AS BIGINT) AS t_sum FROM xdc GROUP BY col_id, basis_id")
def expand_sticks(spark, sf_dir):
    _, x = _xdc(spark, sf_dir)
    return x.groupBy("col_id", "basis_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.sum("t").alias("t_sum"))


_COS = "(CASE WHEN f = 0 THEN 1.0 WHEN f % 2 = 1 THEN cos(2 * pi() * ((f + 1) // 2) * basis_id / 20) ELSE -sin(2 * pi() * (f // 2) * basis_id / 20) END)"


@query(f"{_XDC} SELECT col_id, CAST(f AS INTEGER) AS basis_id, round(sum(s), 3) + 0.0 AS total, round(sum(s * s), 3) AS squares FROM (SELECT recording_id, t, col_id, f, sum(v * {_COS}) AS s FROM xdc, (SELECT unnest(range(0, 5)) AS f) GROUP BY recording_id, t, col_id, f) GROUP BY col_id, f")
def expand_fourier(spark, sf_dir):
    _, x = _xdc(spark, sf_dir)
    y = expand.in_basis(x, expand.time_basis("fourier", 20, 3)[:5])
    return y.groupBy("col_id", "basis_id").agg((F.round(F.sum("v"), 3) + 0.0).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 3).alias("squares"))


def _basis_sql(basis) -> str:
    return "b AS (SELECT * FROM (VALUES " + ", ".join(f"({f}, {lag}, CAST({float(w)!r} AS DOUBLE))" for f, row in enumerate(basis) for lag, w in enumerate(row) if w) + ") v(f, lag, w))"


@query(f"{_XDC}, {_basis_sql(expand.time_basis('splines', 20, 8))} SELECT col_id, CAST(f AS INTEGER) AS basis_id, count(*) AS n, round(sum(s), 3) AS total FROM (SELECT recording_id, t, col_id, f, sum(v * w) AS s FROM xdc JOIN b ON basis_id = lag GROUP BY recording_id, t, col_id, f) GROUP BY col_id, f")
def expand_splines(spark, sf_dir):
    _, x = _xdc(spark, sf_dir)
    y = expand.in_basis(x, expand.time_basis("splines", 20, 8))
    return y.groupBy("col_id", "basis_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query(f"WITH {SIG} SELECT CAST(lag AS INTEGER) AS basis_id, count(*) AS n, round(sum(y), 4) AS total, CAST(sum(t + lag - 3) AS BIGINT) AS t_sum FROM samples, (SELECT unnest(range(0, 8)) AS lag) WHERE channel = 2 AND y <> 0 AND t + lag - 3 BETWEEN 1 AND 43200 GROUP BY lag")
def lagged_signal(spark, sf_dir):
    x = expand.lagged(src.activity(spark, sf_dir), 2, -3, 8, 0)
    return x.groupBy("basis_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.sum("t").alias("t_sum"))


@query(f"WITH {SIG} SELECT recording_id, t + lag AS t, round(sum(y * w), 6) AS v FROM samples, (SELECT unnest([0, 1, 2]) AS lag, unnest([1.0, 0.5, 0.25]::DOUBLE[]) AS w) WHERE channel = 2 AND y <> 0 GROUP BY recording_id, t + lag")
def sparse_convolution(spark, sf_dir):
    x = src.activity(spark, sf_dir).where("channel = 2 and y <> 0").select("recording_id", "t", F.col("y").alias("v"))
    return expand.convolved(x, [1.0, 0.5, 0.25]).select("recording_id", "t", _r("v"))


@query(f"{_XDC} SELECT a.col_id AS col_a, CAST(a.basis_id AS INTEGER) AS basis_a, b.col_id AS col_b, CAST(b.basis_id AS INTEGER) AS basis_b, round(sum(a.v * b.v), 4) AS g FROM xdc a JOIN xdc b USING (recording_id, t) GROUP BY a.col_id, a.basis_id, b.col_id, b.basis_id")
def gram(spark, sf_dir):
    """X'X of all columns and lags from the tiles' products."""
    _, x = _xdc(spark, sf_dir, width=20)
    s = fit.statistics(x, src.activity(spark, sf_dir).where("channel = 1"))
    g = s.total()[1]
    rows = [(*s.keys[i], *s.keys[j], float(g[i, j])) for i, j in zip(*np.nonzero(g), strict=True)]
    return spark.createDataFrame(rows, "col_a int, basis_a int, col_b int, basis_b int, g double")


# ---- fits

_TRUE = {t: {"1": float(i + 1), "value": 0.5 * (i - 2)} for i, t in enumerate(TYPES)}
_SHAPE = [0.2, 0.6, 1.0, 0.4, -0.3, -0.1]


def _known(spark, sf_dir, events=None):
    """A noiseless signal from the single events of each type and sample."""
    e = events if events is not None else src.model_events(spark, sf_dir)
    one = e.withColumn("latency", F.round("latency")).groupBy("recording_id", "type", "latency").agg(F.max_by("value", "event_index").alias("value"), F.max("event_index").alias("event_index"))
    return simulate.superpose(one, _TRUE, _SHAPE, src.N_SAMPLES)


_KERNEL = " UNION ALL ".join(f"SELECT '{t}' AS type, '{n}' AS name, {lag} AS lag, round(CAST({w * v!r} AS DOUBLE), 5) + 0.0 AS beta" for t, p in _TRUE.items() for n, v in (("(Intercept)", p["1"]), ("value", p["value"])) for lag, w in enumerate(_SHAPE))


@query(_KERNEL)
def overlap_fit(spark, sf_dir):
    """The flagship: kernels of five event types, intercept and slope, told apart although they overlap."""
    d, x = _xdc(spark, sf_dir, width=6, lo=0, formula="y ~ 1 + value")
    c = fit.fit_overlap(x, _known(spark, sf_dir))
    names = spark.createDataFrame([(k.col_id, k.event_types[0], "value" if "value" in k.name else "(Intercept)") for k in d.columns], "col_id int, type string, name string")
    return c.join(names, "col_id").select("type", "name", F.col("basis_id").alias("lag"), _r("beta", 5))


@query(_KERNEL)
def overlap_fit_iterative(spark, sf_dir):
    d, x = _xdc(spark, sf_dir, width=6, lo=0, formula="y ~ 1 + value")
    c = fit.fit_overlap(x, _known(spark, sf_dir), "lsmr", tol=1e-12, iterations=2000)
    names = spark.createDataFrame([(k.col_id, k.event_types[0], "value" if "value" in k.name else "(Intercept)") for k in d.columns], "col_id int, type string, name string")
    return c.join(names, "col_id").select("type", "name", F.col("basis_id").alias("lag"), _r("beta", 5))


@query()
def overlap_fit_activity(spark, sf_dir):
    """The same model on the activity signal, condensed from a spline time basis."""
    d, x = _xdc(spark, sf_dir, width=20, lo=-5, formula="y ~ 1 + value")
    basis = expand.time_basis("splines", 20, 8)
    c = fit.fit_overlap(expand.in_basis(x, basis), src.activity(spark, sf_dir), "pinv")
    return postfit.condense(c, basis, -5, 1 / src.STEP_S).select("channel", "col_id", "lag", _r("time_s"), _r("beta", 4))


_EPOCHS = f"""{SIG}, e AS (SELECT recording_id, event_index, type, value, CAST(round(latency) AS BIGINT) AS l FROM ev), cut AS (
 SELECT e.recording_id, event_index, type, value, CAST(b - 5 AS INTEGER) AS lag, s.channel, s.y FROM e, (SELECT unnest(range(0, 15)) AS b) JOIN samples s ON s.recording_id = e.recording_id AND s.t = e.l + b - 5 WHERE e.l - 5 >= 1 AND e.l + 9 <= 43200)"""


@query(f"WITH {_EPOCHS} SELECT type, lag, channel, count(*) AS n, round(avg(y), 6) AS mean_y FROM cut GROUP BY type, lag, channel")
def epochs(spark, sf_dir):
    e = intervals.epochs(src.model_events(spark, sf_dir), src.activity(spark, sf_dir), -5, 15)
    return e.groupBy("type", "lag", "channel").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"))


@query(f"WITH {_EPOCHS} SELECT channel, name, lag, round(b, 4) + 0.0 AS beta FROM (SELECT channel, lag, 'value' AS name, regr_slope(y, value) AS b FROM cut GROUP BY channel, lag UNION ALL SELECT channel, lag, '(Intercept)', regr_intercept(y, value) FROM cut GROUP BY channel, lag)")
def epoch_fit(spark, sf_dir):
    """A regression for each lag, no overlap correction."""
    events = src.model_events(spark, sf_dir)
    d = design(events, "y ~ 1 + value", TYPES)
    samples = src.activity(spark, sf_dir)
    c = fit.fit_epochs(d, samples, -5, 15)
    return c.join(d.metadata().select("col_id", "name"), "col_id").select("channel", "name", "lag", _r("beta", 4))


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_linestatus")
def straight_lines(spark, sf_dir):
    from kernelweave.streaming.online import running_moments, slope

    m = running_moments(src.table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")
    return slope(m, ["l_linestatus"]).select("l_linestatus", _r("slope", 4), _r("intercept", 2))


def _folded(spark, sf_dir, fold_event=None):
    e = src.model_events(spark, sf_dir)
    d, x = _xdc(spark, sf_dir, width=6, lo=0, formula="y ~ 1 + value")
    s = postfit.folds(src.activity(spark, sf_dir), e, n=5, method="equalEntries", modelled=x)
    return d, fit.statistics(x, s, fold="fold")


def _clicks(spark, sf_dir, method):
    """One event type at its own sample: regressions that SQL knows."""
    e = src.model_events(spark, sf_dir)
    d = design(e, "y ~ 1 + value", ["click"])
    x = expand.sticks(expand.single(d.long()), 0, 1, src.N_SAMPLES)
    s = postfit.folds(src.activity(spark, sf_dir), e, n=4, method="equalEntries", modelled=x)
    return d, fit.statistics(x, s, fold="fold")


#: modelled samples with their folds, and what a regression of y on x with or without either column leaves in a fold
_CLICKS = f"""WITH {SIG}, one AS (SELECT recording_id, l, arg_max(value, event_index) AS x FROM lat WHERE type = 'click' AND l BETWEEN 1 AND 43200 GROUP BY recording_id, l),
 m AS (SELECT s.channel, s.y, one.x, least((row_number() OVER (PARTITION BY s.recording_id, s.channel ORDER BY s.t) - 1) * 4 // count(*) OVER (PARTITION BY s.recording_id, s.channel), 3) AS fold FROM samples s JOIN one ON one.recording_id = s.recording_id AND one.l = s.t)"""


def _without(train: str, by: str) -> str:
    """For each group the coefficients of the whole model, of that without slope and of that without intercept."""
    return f"SELECT {by}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS c, sum(x * y) / sum(x * x) AS z FROM {train} GROUP BY {by}"


_LEFT = "1 - sum(power(y - a - b * x, 2)) / nullif(sum(y * y) - power(sum(y), 2) / count(*), 0) AS r, 1 - sum(power(y - c, 2)) / nullif(sum(y * y) - power(sum(y), 2) / count(*), 0) AS no_x, 1 - sum(power(y - z * x, 2)) / nullif(sum(y * y) - power(sum(y), 2) / count(*), 0) AS no_1"
_WHOLE_SQL = f"{_CLICKS}, f AS ({_without('m', 'channel')}), q AS (SELECT CAST(NULL AS INTEGER) AS fold, channel, {_LEFT} FROM m JOIN f USING (channel) GROUP BY channel)"
_CROSS_SQL = f"{_CLICKS}, train AS (SELECT k.fold AS k, m.* FROM m JOIN (SELECT unnest(range(0, 4)) AS fold) k ON m.fold <> k.fold), f AS ({_without('train', 'k, channel')}), q AS (SELECT CAST(fold AS INTEGER) AS fold, m.channel, {_LEFT} FROM m JOIN f ON f.k = m.fold AND f.channel = m.channel GROUP BY m.fold, m.channel)"
_TOTAL = " SELECT fold, channel, CAST(NULL AS VARCHAR) AS variable, CAST(NULL AS DOUBLE) AS r2_ca, round(r, 4) + 0.0 AS r2_total FROM q"
_PARTIAL = " SELECT fold, channel, 'value' AS variable, round(r - no_x, 4) + 0.0 AS r2_ca, round(r, 4) + 0.0 AS r2_total FROM q UNION ALL SELECT fold, channel, '(Intercept)', round(r - no_1, 4) + 0.0, round(r, 4) + 0.0 FROM q"


@query(f"WITH {SIG} SELECT channel, CAST(least((t - 1) * 5 // 43200, 4) AS INTEGER) AS fold, count(*) AS n, round(sum(y), 4) AS sum_y FROM samples GROUP BY 1, 2")
def cv_folds(spark, sf_dir):
    s = postfit.folds(src.activity(spark, sf_dir), src.model_events(spark, sf_dir), n=5, method="equalEntries")
    return s.groupBy("channel", "fold").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("sum_y"))


@query(f"WITH {SIG}, f AS (SELECT DISTINCT recording_id, l FROM lat WHERE type = 'purchase' AND value > 95) SELECT recording_id, fold, count(*) AS n FROM (SELECT s.recording_id, s.t, (SELECT count(*) FROM f WHERE f.recording_id = s.recording_id AND f.l <= s.t) AS fold FROM samples s WHERE channel = 1) GROUP BY 1, 2")
def cv_event_folds(spark, sf_dir):
    e = src.model_events(spark, sf_dir).where("type = 'purchase' and value > 95")
    s = postfit.folds(src.activity(spark, sf_dir).where("channel = 1"), e, "purchase")
    return s.groupBy("recording_id", "fold").agg(F.count("*").alias("n")).withColumn("fold", F.col("fold").cast("long"))


def _fit_table(spark, sf_dir, method):
    d, s = _clicks(spark, sf_dir, method)
    rows = postfit.model_fit(s, d, method)
    return spark.createDataFrame(rows, "fold int, channel int, variable string, r2_ca double, r2_total double").select("fold", "channel", "variable", _r("r2_ca", 4), _r("r2_total", 4))


@query(_WHOLE_SQL + _TOTAL)
def model_r2(spark, sf_dir):
    return _fit_table(spark, sf_dir, "R2")


@query(_WHOLE_SQL + _PARTIAL)
def model_partial_r2(spark, sf_dir):
    return _fit_table(spark, sf_dir, "partialR2")


@query(_CROSS_SQL + _TOTAL)
def model_cv_r2(spark, sf_dir):
    return _fit_table(spark, sf_dir, "crossValR2")


@query(_CROSS_SQL + _PARTIAL)
def model_cv_partial_r2(spark, sf_dir):
    return _fit_table(spark, sf_dir, "crossValpartialR2")


@query()
def elastic_net_cv(spark, sf_dir):
    """The lasso at one standard error, folds of the same pass."""
    d, s = _folded(spark, sf_dir)
    names = {k.col_id: k.name for k in d.columns}
    one = []
    for n, g, c, total, squares, columns in s.folds.values():
        one.append((n, g, c[:, 1], columns, float(total[1]), float(squares[1])))
    got = fit.cv_elastic_net(one, intercept=False)
    rows = [(names[k], int(b), float(v)) for (k, b), v in zip(s.keys, got["beta"], strict=True)]
    return spark.createDataFrame(rows, "name string, lag int, beta double").select("name", "lag", _r("beta", 4))


# ---- intervals


@query(f"""WITH {SIG}, w AS (SELECT recording_id, t AS a, t + 8 AS b, max(y) OVER w - min(y) OVER w AS r FROM samples WHERE channel = 2 WINDOW w AS (PARTITION BY recording_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
 hit AS (SELECT recording_id, a, b FROM w WHERE (a - 1) % 5 = 0 AND b <= 43200 AND r > 60),
 i AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY recording_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new FROM hit),
 g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY a, b) AS k FROM i) SELECT recording_id, min(a) AS start_t, max(b) AS end_t FROM g GROUP BY recording_id, k""")
def artefact_amplitude(spark, sf_dir):
    s = src.activity(spark, sf_dir)
    return intervals.amplitude(s, 1.0, 60.0, 10_000, 5_000, 3_000, [2])


_WIN = "win AS (SELECT DISTINCT recording_id, l - 3 AS start_t, l + 3 AS end_t FROM lat WHERE type = 'error' AND l - 3 >= 1)"


def _windows(spark, sf_dir):
    e = src.model_events(spark, sf_dir).where("type = 'error'").withColumn("l", F.round("latency").cast("long"))
    return e.select("recording_id", (F.col("l") - 3).alias("start_t"), (F.col("l") + 3).alias("end_t")).distinct().where("start_t >= 1")


@query(f"""WITH {SIG}, {_WIN}, i AS (SELECT *, CASE WHEN start_t <= max(end_t) OVER (PARTITION BY recording_id ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM win),
 g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_t, end_t) AS k FROM i) SELECT recording_id, min(start_t) AS start_t, max(end_t) AS end_t FROM g GROUP BY recording_id, k""")
def merge_intervals(spark, sf_dir):
    return intervals.merge(_windows(spark, sf_dir))


@query(f"WITH {SIG}, {_WIN} SELECT recording_id, channel, count(*) AS n, round(sum(y), 4) AS sum_y FROM samples s WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.recording_id = s.recording_id AND s.t BETWEEN start_t AND end_t) GROUP BY recording_id, channel")
def exclude_intervals(spark, sf_dir):
    s = intervals.exclude(src.activity(spark, sf_dir), _windows(spark, sf_dir))
    return s.groupBy("recording_id", "channel").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("sum_y"))


@query(f"""WITH {SIG}, {_WIN}, a AS (SELECT DISTINCT recording_id, type, l + b - 5 AS t FROM lat, (SELECT unnest(range(0, 20)) AS b) WHERE l + b - 5 BETWEEN 1 AND 43200),
 k AS (SELECT type, count(*) AS u, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM win WHERE win.recording_id = a.recording_id AND a.t BETWEEN start_t AND end_t)) AS gone FROM a GROUP BY type)
 SELECT type, 43200.0::DOUBLE AS total_s, (SELECT count(*) FROM ev WHERE ev.type = k.type) * 20 / 1.0::DOUBLE AS no_overlap_s, u / 1.0::DOUBLE AS union_s, gone / 1.0::DOUBLE AS removed_s FROM k""")
def excluded_time(spark, sf_dir):
    return intervals.excluded_time(src.model_events(spark, sf_dir), _windows(spark, sf_dir), -5, 20, 1.0, src.N_SAMPLES)


@query(f"WITH {SIG}, {_WIN} SELECT type, count(*) AS n FROM lat e WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.recording_id = e.recording_id AND start_t <= e.l + 9 AND end_t >= e.l - 5) GROUP BY type")
def clean_events(spark, sf_dir):
    return intervals.clean_events(src.model_events(spark, sf_dir), _windows(spark, sf_dir), -5, 15).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {SIG}, m AS (SELECT recording_id, t, t - row_number() OVER (PARTITION BY recording_id ORDER BY t) AS g FROM samples WHERE channel = 1 AND y > 0)
 SELECT recording_id, min(t) AS start_t, max(t) AS end_t FROM m GROUP BY recording_id, g""")
def active_runs(spark, sf_dir):
    return intervals.runs(src.activity(spark, sf_dir).where("channel = 1 and y > 0"))


_SEG = f"""{SIG}, s AS (SELECT *, (t - 1) // 60 AS seg FROM samples), span AS (SELECT recording_id, channel, min(y) AS lo, max(y) AS hi, count(*) AS cnt FROM s GROUP BY 1, 2),
 b AS (SELECT s.*, cnt, CASE WHEN hi > lo THEN least(floor((y - lo) / (hi - lo) * 100), 99) ELSE 0 END AS bin FROM s JOIN span USING (recording_id, channel)),
 c AS (SELECT recording_id, channel, bin, count(*) AS c FROM b GROUP BY 1, 2, 3), each AS (SELECT recording_id, channel, seg, round(sum(-ln(c / cnt)), 9) AS jp FROM b JOIN c USING (recording_id, channel, bin) GROUP BY 1, 2, 3),
 total AS (SELECT recording_id, 0 AS channel, seg, round(sum(jp), 9) AS jp FROM each GROUP BY 1, 3), every AS (SELECT * FROM each UNION ALL SELECT * FROM total),
 q AS (SELECT recording_id, channel, quantile_cont(jp, 0.1) AS a, quantile_cont(jp, 0.9) AS b FROM every GROUP BY 1, 2),
 norm AS (SELECT recording_id, channel, avg(jp) AS m, stddev_samp(jp) AS sd FROM every JOIN q USING (recording_id, channel) WHERE jp BETWEEN a AND b GROUP BY 1, 2)"""


@query(f"WITH {_SEG} SELECT DISTINCT recording_id, seg * 60 + 1 AS start_t, (seg + 1) * 60 AS end_t FROM every JOIN norm USING (recording_id, channel) WHERE abs((jp - m) / sd) > 5")
def artefact_improbable(spark, sf_dir):
    return intervals.improbable(src.activity(spark, sf_dir), 1.0, 60, 5, 5)


@query(f"""WITH {SIG}, s AS (SELECT recording_id, channel, (t - 1) // 60 AS seg, sqrt(avg(y * y)) AS rms FROM samples GROUP BY 1, 2, 3), m AS (SELECT recording_id, channel, quantile_cont(rms, 0.5) AS m FROM s GROUP BY 1, 2),
 d AS (SELECT recording_id, channel, quantile_cont(abs(rms - m), 0.5) * 1.4826 AS d FROM s JOIN m USING (recording_id, channel) GROUP BY 1, 2),
 hit AS (SELECT DISTINCT recording_id, seg FROM s JOIN m USING (recording_id, channel) JOIN d USING (recording_id, channel) WHERE rms > m + 2.5 * greatest(d, 1e-12)),
 g AS (SELECT *, seg - row_number() OVER (PARTITION BY recording_id ORDER BY seg) AS k FROM hit) SELECT recording_id, CAST(min(seg) * 60 + 1 AS BIGINT) AS start_t, CAST((max(seg) + 1) * 60 AS BIGINT) AS end_t FROM g GROUP BY recording_id, k""")
def artefact_bursts(spark, sf_dir):
    return intervals.bursts(src.activity(spark, sf_dir), 1.0, 2.5, 60)


# ---- after the fit


def _curves(spark, sf_dir):
    d, x = _xdc(spark, sf_dir, width=6, lo=0, formula="y ~ 1 + value")
    c = fit.fit_overlap(x, _known(spark, sf_dir))
    return d, postfit.condense(c, np.eye(6), 0, 1.0)


def _predicted_sql(rows) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS type, CAST({v!r} AS DOUBLE) AS value, {lag} AS lag, round(CAST({b!r} AS DOUBLE), 4) + 0.0 AS beta" for t, v, lag, b in rows)


@query(_predicted_sql([(t, v, lag, w * p["value"] * v) for t, p in _TRUE.items() for v in (10.0, 20.0) for lag, w in enumerate(_SHAPE)]))
def predict_continuous(spark, sf_dir):
    d, c = _curves(spark, sf_dir)
    p = postfit.predict(c, d, {v: [10.0, 20.0] for v in ["value", *[f"{k}_value" for k in range(2, 6)]]})
    return p.where("kind = 'continuous'").select(F.element_at("event_types", 1).alias("type"), "value", "lag", _r("beta", 4))


@query("WITH " + EV + " , m AS (SELECT type, avg(value) AS m FROM ev GROUP BY type) SELECT t.type, t.lag, round(t.a + t.s * m, 3) + 0.0 AS beta FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS type, {lag} AS lag, CAST({w * p['1']!r} AS DOUBLE) AS a, CAST({w * p['value']!r} AS DOUBLE) AS s" for t, p in _TRUE.items() for lag, w in enumerate(_SHAPE)) + ") t JOIN m USING (type)")
def marginal_intercept(spark, sf_dir):
    """The intercept with value at its mean."""
    d, c = _curves(spark, sf_dir)
    p = postfit.predict(c, d, {v: [10.0] for v in ["value", *[f"{k}_value" for k in range(2, 6)]]})
    return postfit.marginal(p, c, d, "MEM").where("kind = 'intercept'").select(F.element_at("event_types", 1).alias("type"), "lag", _r("beta", 3))


_AVERAGES = (
    f"WITH {EV}, h AS (SELECT type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM ev WHERE value IS NOT NULL GROUP BY type), p(type, variable, k, a, s) AS (VALUES "
    + ", ".join(f"('{t}', '{'' if k == 1 else f'{k}_'}', {k}, CAST({p['1']!r} AS DOUBLE), CAST({p['value']!r} AS DOUBLE))" for k, (t, p) in enumerate(_TRUE.items(), 1))
    + "), k(lag, w) AS (VALUES " + ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(_SHAPE))
    + "), r AS (SELECT type, v, greatest(1.0, least(n, n * i / 11.0 + 0.5)) AS r FROM h, range(1, 11) t(i)), q AS (SELECT type, v[CAST(floor(r) AS BIGINT)] + (v[CAST(ceil(r) AS BIGINT)] - v[CAST(floor(r) AS BIGINT)]) * (r - floor(r)) AS value FROM r)"
    " SELECT h.type AS events, variable || '(Intercept)' AS variable, CAST(NULL AS DOUBLE) AS value, lag, round(w * (a + s * m) + 1e-6, 3) + 0.0 AS beta FROM h JOIN p ON p.type = h.type, k"
    " UNION ALL SELECT q.type, variable || 'value', round(value, 4) + 0.0, lag, round(w * (a + s * value) + 1e-6, 3) + 0.0 FROM q JOIN p ON p.type = q.type, k"
)


@query(_AVERAGES)
def marginal_average(spark, sf_dir):
    """Average marginal effects: each parameter with the other of its event set averaged over the events."""
    d, c = _curves(spark, sf_dir)
    m = postfit.marginal(postfit.predict(c, d), c, d, "AME").withColumn("beta", F.col("beta") + 1e-6)  # no value stands just between two roundings
    return m.select(F.array_join("event_types", " ").alias("events"), "variable", _r("value", 4), "lag", _r("beta", 3))


@query(f"""{_CLICKS}, f AS (SELECT channel, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m GROUP BY channel), i AS (SELECT m.channel, sum(power(y - a - b * x, 2)) AS inside, sum(y * y) AS was FROM m JOIN f ON f.channel = m.channel GROUP BY m.channel)
 SELECT s.channel, count(*) AS n, round(sum(y * y) - any_value(was) + any_value(inside), 3) AS residual FROM samples s JOIN i ON i.channel = s.channel GROUP BY s.channel""")
def residual_signal(spark, sf_dir):
    """Squares of what a regression at clicks leaves of the signal; where no click is, all of it."""
    d = design(src.model_events(spark, sf_dir), "y ~ 1 + value", ["click"])
    x, s = expand.sticks(expand.single(d.long()), 0, 1, src.N_SAMPLES), src.activity(spark, sf_dir)
    r = postfit.residuals(s, x, fit.fit_overlap(x, s))
    return r.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum(F.col("residual") * F.col("residual")), 3).alias("residual"))


@query(f"""WITH {_EPOCHS}, m AS (SELECT recording_id, event_index, lag, avg(y) AS y FROM cut GROUP BY 1, 2, 3), k AS (SELECT DISTINCT recording_id, event_index FROM m),
 o AS (SELECT k.*, row_number() OVER (PARTITION BY k.recording_id ORDER BY value DESC, k.event_index) AS trial FROM k JOIN ev ON ev.recording_id = k.recording_id AND ev.event_index = k.event_index)
 SELECT CAST(trial AS INTEGER) AS trial, m.event_index, lag, round(y, 6) AS y FROM m JOIN o USING (recording_id, event_index)""")
def single_trials(spark, sf_dir):
    """All trials of each recording, by falling value."""
    t = postfit.single_trials(src.model_events(spark, sf_dir), src.activity(spark, sf_dir), -5, 15, "raw", None, "value", True)
    return t.select("trial", "event_index", "lag", _r("y"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS event, '{n}' AS predictor, CAST(NULL AS DOUBLE) AS predictorvalue, 1 AS channel, CAST({lag} AS DOUBLE) AS time, round(CAST({w * v!r} AS DOUBLE), 4) + 0.0 AS data, 'deconv' AS method" for k, (t, p) in enumerate(_TRUE.items(), 1) for n, v in (("(Intercept)" if k == 1 else f"{k}_(Intercept)", p["1"]), ("value" if k == 1 else f"{k}_value", p["value"])) for lag, w in enumerate(_SHAPE)))
def tidy_export(spark, sf_dir):
    d, c = _curves(spark, sf_dir)
    return src.tidy(c, d.metadata()).select("event", "predictor", "predictorvalue", "channel", "time", _r("data", 4), "method")


def _subject_means(spark, sf_dir):
    e = intervals.epochs(src.model_events(spark, sf_dir), src.activity(spark, sf_dir), -5, 15)
    return e.groupBy("recording_id", "type", "channel", "lag").agg(F.avg("y").alias("beta"))


@query(f"""WITH {_EPOCHS}, m AS (SELECT recording_id, type, channel, lag, avg(y) AS beta FROM cut GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY type, channel, lag) AS n FROM m WINDOW w AS (PARTITION BY type, channel, lag ORDER BY beta))
 SELECT type, channel, lag, round(avg(beta), 5) AS trimmed FROM r WHERE k > floor(n * 0.25) AND k <= n - floor(n * 0.25) GROUP BY 1, 2, 3""")
def group_trimmed_mean(spark, sf_dir):
    return plotdata.group_mean(_subject_means(spark, sf_dir), ["type", "channel", "lag"], 50).select("type", "channel", "lag", _r("trimmed", 5))


@query()
def group_bootstrap(spark, sf_dir):
    return plotdata.bootstrap_ci(_subject_means(spark, sf_dir), ["type", "channel", "lag"], 100).select("type", "channel", "lag", _r("lo", 5), _r("hi", 5))


@query(f"""WITH {_EPOCHS}, m AS (SELECT type, channel, lag, avg(y) AS beta FROM cut GROUP BY 1, 2, 3) SELECT type, channel, lag, round(beta - avg(CASE WHEN lag >= -5 AND lag < 0 THEN beta END) OVER (PARTITION BY type, channel), 5) + 0.0 AS beta FROM m""")
def baseline_curves(spark, sf_dir):
    e = intervals.epochs(src.model_events(spark, sf_dir), src.activity(spark, sf_dir), -5, 15)
    m = e.groupBy("type", "channel", "lag").agg(F.avg("y").alias("beta")).withColumn("time_s", F.col("lag").cast("double"))
    return plotdata.baseline(m, -5.0, 0.0, ["type", "channel"]).select("type", "channel", "lag", _r("beta", 5))


def _slices() -> list[tuple[int, int, float, float]]:
    """(col_id, slice, mean, limit) of the known kernels in three slices: of three values the outermost quantiles are the least and the largest."""
    out = []
    for i, size in enumerate(v for p in _TRUE.values() for v in (p["1"], p["value"])):
        means = [size * (_SHAPE[2 * k] + _SHAPE[2 * k + 1]) / 2 for k in range(3)]
        out += [(i, k, m, max(map(abs, means))) for k, m in enumerate(means)]
    return out


@query(" UNION ALL ".join(f"SELECT {c} AS col_id, 1 AS channel, CAST({k} AS BIGINT) AS slice, round(CAST({m!r} AS DOUBLE), 4) + 0.0 AS beta, round(CAST({limit!r} AS DOUBLE), 4) + 0.0 AS \"limit\"" for c, k, m, limit in _slices()))
def topographies(spark, sf_dir):
    _, c = _curves(spark, sf_dir)
    return plotdata.topographies(c, 3).select("col_id", "channel", F.col("slice").cast("long"), _r("beta", 4), _r("limit", 4))


@query("""WITH p AS (SELECT l_returnflag, l_quantity AS a, l_quantity - 2.0 - l_tax AS b FROM lineitem),
 r AS (SELECT *, count(*) OVER w AS n, floor(count(*) OVER w * 0.2) AS g, row_number() OVER (PARTITION BY l_returnflag ORDER BY a) AS ra, row_number() OVER (PARTITION BY l_returnflag ORDER BY b) AS rb FROM p WINDOW w AS (PARTITION BY l_returnflag)),
 m AS (SELECT l_returnflag, avg(a) FILTER (WHERE ra > g AND ra <= n - g) - avg(b) FILTER (WHERE rb > g AND rb <= n - g) AS diff, max(a) FILTER (WHERE ra = g + 1) AS alo, max(a) FILTER (WHERE ra = n - g) AS ahi, max(b) FILTER (WHERE rb = g + 1) AS blo, max(b) FILTER (WHERE rb = n - g) AS bhi FROM r GROUP BY l_returnflag),
 v AS (SELECT l_returnflag, any_value(n) AS n, any_value(n - 2 * g) AS h, any_value(diff) AS diff, var_samp(least(greatest(a, alo), ahi)) + var_samp(least(greatest(b, blo), bhi)) - 2 * covar_samp(least(greatest(a, alo), ahi), least(greatest(b, blo), bhi)) AS v FROM r JOIN m USING (l_returnflag) GROUP BY l_returnflag)
 SELECT l_returnflag, n, round(diff, 6) AS diff, round(sqrt(v * (n - 1) / (h * (h - 1))), 7) AS se, CAST(h - 1 AS DOUBLE) AS df FROM v""")
def yuen_test(spark, sf_dir):
    """Quantity against itself less a constant and the tax."""
    li = src.table(spark, sf_dir, "lineitem").withColumn("other", F.col("l_quantity") - 2.0 - F.col("l_tax"))
    return stats.yuen_dependent(li, "l_quantity", "other", ["l_returnflag"]).select("l_returnflag", "n", _r("diff"), _r("se", 7), "df")


@query("""WITH p AS (SELECT l_extendedprice AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS w FROM lineitem), g AS (SELECT s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS n FROM p GROUP BY s),
 c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def weighted_auc(spark, sf_dir):
    li = src.table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return plotdata.weighted_auc(li, "l_extendedprice", "label", "l_quantity").select(_r("auc"))


@query("""WITH c AS (SELECT vec_id AS channel, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT a.channel, b.channel AS neighbour FROM c a JOIN c b ON a.channel <> b.channel
 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) < 0.05""")
def sensor_neighbours(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("channel"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    return plotdata.neighbours(c, 0.05)


@query(f"WITH {EV} SELECT type, count(*) AS n, count(k) AS n_k, count(value) AS n_value FROM (SELECT type, value, NULL AS k FROM ev WHERE type = 'click' UNION ALL SELECT type, NULL, k FROM ev WHERE type = 'view') GROUP BY type")
def merged_events(spark, sf_dir):
    e = src.model_events(spark, sf_dir)
    m = plotdata.merge_events(e.where("type = 'click'").drop("k"), e.where("type = 'view'").drop("value"))
    return m.groupBy("type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.count("value").alias("n_value"))


# ---- generalised models, SQL functions, curves with intercepts

_LOGIT = "SELECT a.name, round(a.v, 4) + 0.0 AS beta FROM (SELECT ln(avg(y) FILTER (WHERE x = 0) / (1 - avg(y) FILTER (WHERE x = 0))) AS p0, ln(avg(y) FILTER (WHERE x = 1) / (1 - avg(y) FILTER (WHERE x = 1))) AS p1 FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS x FROM lineitem)) t, LATERAL (SELECT '(Intercept)' AS name, p0 AS v UNION ALL SELECT 'x', p1 - p0) a"


@query(_LOGIT)
def logistic_fit(spark, sf_dir):
    """Without penalty and with one binary predictor: log odds of both groups."""
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("x"))
    b = glm_path(li, ["x"], "y", "binomial", lambdas=[0.0]).at(0.0)
    return spark.createDataFrame([("(Intercept)", float(b[0])), ("x", float(b[1]))], "name string, beta double").select("name", _r("beta", 4))


@query("SELECT a.name, round(a.v, 4) + 0.0 AS beta FROM (SELECT ln(avg(y) FILTER (WHERE x = 0)) AS p0, ln(avg(y) FILTER (WHERE x = 1)) AS p1 FROM (SELECT l_quantity AS y, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS x FROM lineitem)) t, LATERAL (SELECT '(Intercept)' AS name, p0 AS v UNION ALL SELECT 'x', p1 - p0) a")
def poisson_fit(spark, sf_dir):
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("x"))
    b = glm_path(li, ["x"], "y", "poisson", lambdas=[0.0]).at(0.0)
    return spark.createDataFrame([("(Intercept)", float(b[0])), ("x", float(b[1]))], "name string, beta double").select("name", _r("beta", 4))


@query()
def elastic_net_path(spark, sf_dir):
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem")
    path = glm_path(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", alpha=0.5, lambdas=[10_000.0, 100.0, 1.0, 0.0])
    rows = [(float(lam), c, float(v)) for lam, b in zip(path.lambdas, path.coefs, strict=True) for c, v in zip(path.columns, b, strict=True)]
    return spark.createDataFrame(rows, "lambda double, name string, beta double").select("lambda", "name", _r("beta", 3))


_SURVIVAL = """WITH RECURSIVE s AS (SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS e, CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS x FROM lineitem),
 g AS (SELECT t, sum(e) AS d, sum(e * x) AS d1, sum(x) AS n1, sum(1 - x) AS n0 FROM s GROUP BY t),
 r AS (SELECT d, d1, sum(n1) OVER (ORDER BY t DESC) AS r1, sum(n0) OVER (ORDER BY t DESC) AS r0 FROM g),
 it AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS b UNION ALL SELECT k + 1, b + (SELECT sum(d1 - d * r1 * exp(it.b) / (r0 + r1 * exp(it.b))) / sum(d * r0 * r1 * exp(it.b) / ((r0 + r1 * exp(it.b)) * (r0 + r1 * exp(it.b)))) FROM r) FROM it WHERE k < 20)
 SELECT 'x' AS name, round(b, 6) + 0.0 AS beta FROM it WHERE k = 20"""


@query(_SURVIVAL)
def cox_fit(spark, sf_dir):
    """The log hazard ratio of two groups; the SQL takes Newton steps on the risk sets of each time."""
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("double").alias("event"), (F.col("l_discount") >= 0.05).cast("double").alias("x"))
    b = glm_path(li, ["x"], ["l_quantity", "event"], "cox", lambdas=[0.0]).at(0.0)
    return spark.createDataFrame([("x", float(b[1]))], "name string, beta double").select("name", _r("beta"))


@query("""WITH c AS (SELECT l_returnflag AS class, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x, ln(count(*)) AS l FROM lineitem GROUP BY 1, 2), m AS (SELECT class, x, l - avg(l) OVER (PARTITION BY x) AS v FROM c)
 SELECT class, '(Intercept)' AS name, round(v, 5) + 0.0 AS beta FROM m WHERE x = 0 UNION ALL SELECT a.class, 'x', round(b.v - a.v, 5) + 0.0 FROM m a JOIN m b ON a.class = b.class AND a.x = 0 AND b.x = 1""")
def multinomial_fit(spark, sf_dir):
    """Three classes on one binary predictor: centred log counts of both groups."""
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("double").alias("x"))
    path = glm_path(li, ["x"], "l_returnflag", "multinomial", lambdas=[0.0])
    rows = [(c, n, float(v)) for n, b in zip(("(Intercept)", "x"), path.at(0.0), strict=True) for c, v in zip(path.classes, b, strict=True)]
    return spark.createDataFrame(rows, "class string, name string, beta double").select("class", "name", _r("beta", 5))


@query("""WITH s AS (SELECT var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice / 1000) AS c1, covar_pop(l_quantity, l_discount * 100) AS c2 FROM lineitem),
 b AS (SELECT unnest([1.0, 0.5, 0.1, 0.0]) * sqrt(c1 * c1 + c2 * c2) / sqrt(v) AS lam, v, c1, c2 FROM s), f AS (SELECT lam, greatest(0.0, 1 - lam * sqrt(v) / sqrt(c1 * c1 + c2 * c2)) / v AS f, c1, c2 FROM b)
 SELECT round(lam, 6) AS lam, response, round(CASE response WHEN 'price' THEN c1 ELSE c2 END * f, 6) + 0.0 AS beta FROM f, (SELECT unnest(['price', 'discount']) AS response) r""")
def multi_response_path(spark, sf_dir):
    """Two responses on one predictor: a group lasso shrinks both coefficients by one factor."""
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount"))
    s = li.agg(F.var_pop("x").alias("v"), F.covar_pop("x", "price").alias("c1"), F.covar_pop("x", "discount").alias("c2")).first()
    top = float(np.hypot(s["c1"], s["c2"]) / np.sqrt(s["v"]))
    path = glm_path(li, ["x"], ["price", "discount"], "mgaussian", lambdas=[top, 0.5 * top, 0.1 * top, 0.0])
    rows = [(float(lam), r, float(v)) for lam, b in zip(path.lambdas, path.coefs, strict=True) for r, v in zip(("price", "discount"), b[0], strict=True)]
    return spark.createDataFrame(rows, "lam double, response string, beta double").select(_r("lam"), "response", _r("beta"))


@query("""WITH s AS (SELECT var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_extendedprice) AS y FROM lineitem), l AS (SELECT i, abs(c) / sqrt(v) * power(1e-4, i / 99.0) AS lam, v, c, y FROM s, range(100) r(i)),
 b AS (SELECT i, lam, sign(c) * greatest(0.0, abs(c) - lam * sqrt(v)) / v AS beta, v, c, y FROM l)
 SELECT CAST(i AS INTEGER) AS step, round(lam, 4) AS lam, round(beta, 4) + 0.0 AS beta, round((2 * beta * c - beta * beta * v) / y, 6) + 0.0 AS explained FROM b""")
def default_path(spark, sf_dir):
    """The path of 100 lambdas from the data, with the share of deviance explained; one predictor's is a soft threshold."""
    from kernelweave.operators.glm import glm_path

    li = src.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    path = glm_path(li, ["x"], "y")
    rows = [(i, float(lam), float(b[0]), s) for i, (lam, b, (_, s, _)) in enumerate(zip(path.lambdas, path.coefs, path.table(), strict=True))]
    return spark.createDataFrame(rows, "step int, lam double, beta double, explained double").select("step", _r("lam", 4), _r("beta", 4), _r("explained"))


@query("""WITH d AS (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem), k AS (SELECT DISTINCT fold FROM d), l AS (SELECT unnest([5.0, 1.0, 0.0]) AS lam),
 f AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c FROM k JOIN d ON d.fold <> k.fold GROUP BY k.fold),
 m AS (SELECT fold, lam, mx, my, sign(c) * greatest(0.0, abs(c) - lam * sqrt(v)) / v AS b FROM f, l),
 e AS (SELECT lam, d.fold, count(*) AS n, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS mse FROM d JOIN m ON m.fold = d.fold GROUP BY lam, d.fold),
 t AS (SELECT lam, sum(n * mse) / sum(n) AS cvm FROM e GROUP BY lam)
 SELECT CAST(e.lam AS DOUBLE) AS lam, round(any_value(cvm), 5) AS cvm, round(sqrt(sum(n * (mse - cvm) * (mse - cvm)) / sum(n) / 4), 5) AS cvse FROM e JOIN t ON t.lam = e.lam GROUP BY e.lam""")
def glm_cross_validation(spark, sf_dir):
    """Five folds side by side: held-out squared error and its standard error at each lam."""
    from kernelweave.operators.glm import glm_cv

    li = src.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    cv = glm_cv(li, ["x"], "y", "fold", loss="mse", lambdas=[5.0, 1.0, 0.0])
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(cv["path"].lambdas, cv["cvm"], cv["cvse"], strict=True)]
    return spark.createDataFrame(rows, "lam double, cvm double, cvse double").select("lam", _r("cvm", 5), _r("cvse", 5))


@query(f"{_XDC} SELECT CAST(basis_id - 5 AS INTEGER) AS lag, count(*) AS n FROM xdc WHERE col_id = 1 GROUP BY basis_id")
def sql_time_expand(spark, sf_dir):
    """The table function, in SQL."""
    from kernelweave.functions.sql import register

    register(spark)
    e = src.model_events(spark, sf_dir).where("type = 'error'").select("recording_id", F.round("latency").alias("latency")).distinct()
    e.createOrReplaceTempView("error_events")
    return spark.sql(f"SELECT x.lag, count(*) AS n FROM error_events e, LATERAL time_expand(e.latency, -5, 20) x WHERE x.t BETWEEN 1 AND {src.N_SAMPLES} GROUP BY x.lag")


@query(f"WITH {EV} SELECT type, round(sum(k), 3) AS first, round(sum(k * k), 3) AS second FROM ev GROUP BY type")
def custom_spline(spark, sf_dir):
    from kernelweave.functions.sql import custom_basis, polynomial

    e = src.model_events(spark, sf_dir).withColumn("b", custom_basis(F.col("k"), polynomial, [0.0, 1.0]))
    return e.groupBy("type").agg(F.round(F.sum(F.col("b")[0]), 3).alias("first"), F.round(F.sum(F.col("b")[1]), 3).alias("second"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, {lag} AS lag, round(CAST({w * (p['1'] + p['value'])!r} AS DOUBLE), 4) + 0.0 AS beta" for t, p in _TRUE.items() for lag, w in enumerate(_SHAPE)))
def curves_with_intercept(spark, sf_dir):
    d, c = _curves(spark, sf_dir)
    out = plotdata.with_intercept(c, d.metadata())
    types = spark.createDataFrame([(k.col_id, k.event_types[0]) for k in d.columns], "col_id int, type string")
    return out.where("kind = 'continuous'").join(types, "col_id").select("type", "lag", _r("beta", 4))


@query(f"WITH {EV}, x AS (SELECT recording_id, event_index, CASE WHEN type IN ('click', 'view') THEN value ELSE 0 END AS v FROM ev) SELECT recording_id, count(*) AS n, round(sum(sign(v) * ln(1 + abs(v))), 3) AS total FROM x GROUP BY recording_id")
def design_image(spark, sf_dir):
    d = design(src.model_events(spark, sf_dir), "y ~ 1 + value", [["click", "view"]])
    i = plotdata.design_image(d.wide(), d.names).where("column = 'value'")
    return i.groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.sum("signed_log"), 3).alias("total"))


# ---- sparse rows, single events


@query(f"{_CLICKS} SELECT channel, name, round(b, 4) + 0.0 AS beta FROM (SELECT channel, 'value' AS name, regr_slope(y, x) AS b FROM m GROUP BY channel UNION ALL SELECT channel, '(Intercept)', regr_intercept(y, x) FROM m GROUP BY channel)")
def sparse_fit(spark, sf_dir):
    """LSMR on the rows of one event type at its own sample, where SQL knows the regression."""
    d = design(src.model_events(spark, sf_dir), "y ~ 1 + value", ["click"])
    c = fit.fit_overlap(expand.sticks(expand.single(d.long()), 0, 1, src.N_SAMPLES), src.activity(spark, sf_dir), "lsmr", tol=1e-12)
    return c.join(d.metadata().select("col_id", "name"), "col_id").select("channel", "name", _r("beta", 4))


@query(f"WITH {ONE}, size(type, a) AS (VALUES " + ", ".join(f"('{t}', CAST({p['1']!r} AS DOUBLE))" for t, p in _TRUE.items()) + "), k(lag, w) AS (VALUES " + ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(_SHAPE)) + ") SELECT recording_id, round(sum(a * w), 3) + 0.0 AS kept FROM one JOIN size USING (type), k WHERE l + lag BETWEEN 1 AND 43200 GROUP BY recording_id")
def kept_predictors(spark, sf_dir):
    """What the intercepts alone say of the signal, slopes left out."""
    d, x = _xdc(spark, sf_dir, width=6, lo=0, formula="y ~ 1 + value")
    s = _known(spark, sf_dir)
    y = postfit.adjusted(s, x, fit.fit_overlap(x, s), keep=[c.col_id for c in d.columns if c.kind == "intercept"])
    return y.groupBy("recording_id").agg((F.round(F.sum("y_hat"), 3) + 0.0).alias("kept"))


@query(f"WITH {EV}, lat AS (SELECT *, CAST(round(latency) AS BIGINT) AS l FROM ev) SELECT e.recording_id, e.event_index, round(arg_min(o.latency - e.l, o.l * 1000000000 + o.event_index), 6) AS found FROM lat e LEFT JOIN lat o ON o.recording_id = e.recording_id AND o.type = 'purchase' AND o.l BETWEEN e.l - 5 AND e.l + 94 WHERE e.type = 'error' GROUP BY e.recording_id, e.event_index")
def epoch_first_event(spark, sf_dir):
    """The first purchase from 5 samples before to 94 after each error."""
    e = src.model_events(spark, sf_dir)
    return intervals.event_in_epoch(e.where("type = 'error'"), e.where("type = 'purchase'"), -5, 100).select("recording_id", "event_index", _r("found"))


@query(f"WITH {EV} SELECT CAST(p AS INTEGER) AS power, count(*) AS n, round(sum(power(k, p)), 3) AS total FROM ev, (SELECT unnest([1, 2]) AS p) WHERE type = 'click' GROUP BY p")
def design_custom_spline(spark, sf_dir):
    """Powers of k as a user's basis; the third, the largest at the mean, goes."""
    from kernelweave.functions.sql import polynomial
    from kernelweave.operators.design import add_spline

    d = add_spline(design(src.model_events(spark, sf_dir), "y ~ 1", ["click"]), "k", ["click"], polynomial, [0.0, 1.0, 2.0])
    return d.long().where("col_id > 0").groupBy(F.col("col_id").alias("power")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


# ---- trials in one call, tables of parameters, sets of intervals

_SHAPES = "k(lag, w) AS (VALUES " + ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(_SHAPE)) + ")"


@query(f"""WITH {_EPOCHS}, f AS (SELECT e.recording_id, e.event_index, arg_min(o.latency - e.l, o.l * 1000000000 + o.event_index) AS sort FROM lat e LEFT JOIN lat o ON o.recording_id = e.recording_id AND o.type = 'purchase' AND o.l BETWEEN e.l AND e.l + 60 WHERE e.type = 'error' GROUP BY e.recording_id, e.event_index),
 m AS (SELECT recording_id, event_index, lag, avg(y) AS y FROM cut WHERE type = 'error' GROUP BY 1, 2, 3), d AS (SELECT DISTINCT recording_id, event_index FROM m),
 r AS (SELECT d.*, sort, row_number() OVER (PARTITION BY d.recording_id ORDER BY sort ASC NULLS LAST, d.event_index) AS trial FROM d JOIN f USING (recording_id, event_index))
 SELECT m.recording_id, CAST(trial AS INTEGER) AS trial, m.event_index, lag, round(y, 6) AS y, round(sort, 6) AS sort FROM m JOIN r USING (recording_id, event_index)""")
def trial_image_raw(spark, sf_dir):
    """Raw trials of errors, by the latency of the first purchase in the minute after each."""
    from kernelweave.operators.trials import trial_image

    d = _typed(spark, sf_dir, "y ~ 1")
    t = trial_image(d, src.activity(spark, sf_dir), -5, 15, 1.0, "raw", align_to=["error"], sort_align_to=["purchase"], sort_time=(0.0, 60.0))
    return t.select("recording_id", "trial", "event_index", "lag", _r("y"), _r("sort"))


@query(f"""WITH {EV}, {_SHAPES}, e AS (SELECT *, CAST(round(latency) AS BIGINT) AS l FROM ev WHERE type = 'click'), f AS (SELECT recording_id, l, arg_min(value, event_index) AS sort FROM e GROUP BY 1, 2),
 d AS (SELECT e.*, sort, row_number() OVER (PARTITION BY e.recording_id ORDER BY sort DESC, event_index) AS trial FROM e JOIN f ON f.recording_id = e.recording_id AND f.l = e.l WHERE e.l >= 1 AND e.l + 5 <= 43200)
 SELECT recording_id, CAST(trial AS INTEGER) AS trial, event_index, CAST(lag AS INTEGER) AS lag, round(w * {_TRUE['click']['value']!r} * value, 3) + 0.0 AS y, round(sort, 6) AS sort FROM d, k""")
def trial_image_modelled(spark, sf_dir):
    """What the slope alone says of each click, without its neighbours, by falling value of the first click at its sample."""
    from kernelweave.operators.trials import trial_image

    d, curves = _curves(spark, sf_dir)
    slope = next(c.variable for c in d.columns if c.kind == "continuous" and "click" in c.event_types)
    t = trial_image(d, _known(spark, sf_dir), 0, 6, 1.0, curves=curves, keep=[slope], align_to=["click"], sort_by="value", sort_time=(0.0, 0.0), descending=True)
    return t.select("recording_id", "trial", "event_index", F.col("lag").cast("int").alias("lag"), _r("y", 3), _r("sort"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS event, CAST({v} AS DOUBLE) AS value, CAST({lag} AS DOUBLE) AS time_s, round(CAST({w * (p['1'] + p['value'] * v)!r} AS DOUBLE), 3) + 0.0 AS beta" for t, p in _TRUE.items() for v in (0.0, 10.0) for lag, w in enumerate(_SHAPE)))
def parameter_curves(spark, sf_dir):
    """Predicted curves of the slopes at two values, with their intercepts."""
    d, curves = _curves(spark, sf_dir)
    slopes = [c.variable for c in d.columns if c.kind == "continuous"]
    t = plotdata.parameter_table(curves, d, {v: [0.0, 10.0] for v in slopes}, add_intercept=True, variables=slopes)
    return t.select("event", "value", "time_s", _r("beta", 3))


@query(f"""WITH {EV}, {_SHAPES}, r AS (SELECT min(value) AS a, max(value) AS b FROM ev WHERE type = 'click'), v AS (SELECT a + (b - a) * i / 99.0 AS value FROM r, range(100) t(i))
 SELECT round(value, 6) AS value, CAST(lag AS DOUBLE) AS time_s, round(w * {_TRUE['click']['value']!r} * value, 3) + 0.0 AS beta FROM v, k""")
def parameter_image(spark, sf_dir):
    """The cells of a value x time image of clicks' slope, 100 values."""
    d, curves = _curves(spark, sf_dir)
    slope = next(c.variable for c in d.columns if c.kind == "continuous" and "click" in c.event_types)
    return plotdata.value_image(curves, d, slope).select(_r("value"), "time_s", _r("beta", 3))


@query(f"""WITH {EV}, lat AS (SELECT *, CAST(round(latency) AS BIGINT) AS l FROM ev), i AS (SELECT 'errors' AS name, recording_id, l AS a, l + 30 AS b FROM lat WHERE type = 'error' UNION ALL SELECT 'purchases', recording_id, l - 10, l + 10 FROM lat WHERE type = 'purchase'),
 t AS (SELECT DISTINCT name, recording_id, unnest(range(a, b + 1)) AS t FROM i), n AS (SELECT name, count(*) AS n FROM t GROUP BY name UNION ALL SELECT 'union', count(*) FROM (SELECT DISTINCT recording_id, t FROM t))
 SELECT name, CAST(n AS DOUBLE) AS seconds FROM n UNION ALL SELECT 'repeated', CAST(sum(CASE WHEN name = 'union' THEN -n ELSE n END) AS DOUBLE) FROM n""")
def interval_sets(spark, sf_dir):
    """Seconds of two sets of intervals, of their union and of what they have in common."""
    e = src.model_events(spark, sf_dir).withColumn("l", F.round("latency").cast("long"))
    sets = {
        "errors": e.where("type = 'error'").select("recording_id", F.col("l").alias("start_t"), (F.col("l") + 30).alias("end_t")),
        "purchases": e.where("type = 'purchase'").select("recording_id", (F.col("l") - 10).alias("start_t"), (F.col("l") + 10).alias("end_t")),
    }
    return intervals.merge_sets(sets, 1.0)[1]


@query("SELECT g, unnest([0.05, 0.5, 0.95])::DOUBLE AS p, round(unnest(q), 4) AS q FROM (SELECT l_returnflag AS g, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.05, 0.5, 0.95]) AS q FROM lineitem GROUP BY l_returnflag)")
def grouped_quantiles(spark, sf_dir):
    """Quantiles inside large groups, each dealt to ranges of values."""
    q = stats.hazen(src.table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95], ["l_returnflag"], rule="linear")
    return q.select(F.col("l_returnflag").alias("g"), "p", _r("q", 4))
