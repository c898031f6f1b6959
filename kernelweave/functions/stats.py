"""Quantiles, trimmed means, correlations, inflation factors, tests: aggregates of DataFrames."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """Missing numbers are null, never NaN."""
    return F.when(~F.isnan(x), x)


#: Ranges of values that running sums over a whole table are dealt to.
TILES = 64


def tiled(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """df with _tile: ranges of x, inside each group, with about as many rows each, from approximate quantiles of the same plan (TILES numbers a group)."""
    edges = F.percentile_approx(F.col(x).cast("double"), [i / TILES for i in range(1, TILES)], 1000).alias("_edges")
    if by:
        groups = df.groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(edges)
        out = df.join(groups, reduce(and_, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])).drop(*[f"_by{i}" for i in range(len(by))])
    else:
        out = df.crossJoin(F.broadcast(df.agg(edges)))
    return out.withColumn("_tile", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")


def running(df: DataFrame, x: str, amount: str, by: list[str] | None = None) -> DataFrame:
    """df with _to, the sum of amount up to each x (distinct values in a group), and _all, of the group: ranges apart, then what stands before each."""
    by = by or []
    t = tiled(df, x, by)
    sums = t.groupBy(*by, "_tile").agg(F.sum(amount).alias("_sum"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # at most TILES rows
    before = F.sum("_sum").over(group.orderBy("_tile")) - F.col("_sum")
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_tile").alias("_of"), before.alias("_before"), F.sum("_sum").over(group).alias("_all"))
    inside = F.sum(amount).over(W.partitionBy(*by, "_tile").orderBy(x))
    on = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)], F.col("_tile") == F.col("_of"))
    return t.withColumn("_in", inside).join(sums, on).withColumn("_to", F.col("_before") + F.col("_in")).select(*df.columns, "_to", "_all")


def counted(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by.., _x, _n, _from, _to, _all): the distinct values of each group, how many there are, and their places 1.. as (_from, _to]."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    return running(counts, "_x", "_n", by).withColumn("_from", F.col("_to") - F.col("_n"))


def hazen(df: DataFrame, value: str, ps: list[float], by: list[str] | None = None, rule: str = "hazen") -> DataFrame:
    """(by.., p, q): quantiles with midpoint interpolation at rank n p + 1/2; rule linear: at rank (n - 1) p + 1.

    From distinct values and their counts, so that the ordered table holds no value twice; a group, or the
    whole table, is dealt to ranges of values; only the rows at the wanted ranks are kept. Nulls are skipped; groups without values give no rows.
    """
    by = by or []
    rank = {"hazen": lambda p: F.col("_all") * F.lit(float(p)) + 0.5, "linear": lambda p: (F.col("_all") - 1) * F.lit(float(p)) + 1.0}[rule]
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1.0), F.least(F.col("_all").cast("double"), rank(p))).alias("r")) for p in ps]))
    hits = counted(df, value, by).select(*by, "_x", "_from", "_to", wanted.alias("_w")).select(*by, "_x", "_from", "_to", "_w.p", "_w.r")
    low = F.when((F.col("_from") < F.floor("r")) & (F.floor("r") <= F.col("_to")), F.col("_x"))
    high = F.when((F.col("_from") < F.ceil("r")) & (F.ceil("r") <= F.col("_to")), F.col("_x"))
    out = hits.groupBy(*by, "p").agg(F.max(low).alias("_l"), F.max(high).alias("_h"), F.max("r").alias("_r"))
    return out.select(*by, "p", (F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("_r") - F.floor("_r"))).alias("q"))


def quantiles(df: DataFrame, value: str, ps: list[float]) -> list[float]:
    """A few Hazen quantiles, collected."""
    found = {r["p"]: r["q"] for r in hazen(df, value, sorted(set(ps))).collect()}
    return [found[float(p)] for p in ps] if found else []


def trimmed_mean(df: DataFrame, value: str, by: list[str], percent: float = 20.0) -> DataFrame:
    """(by.., trimmed): the mean without the highest and lowest percent / 2 of each group's values."""
    cut = F.floor(F.col("_all") * F.lit(percent / 200.0))
    kept = F.least(F.col("_to"), F.col("_all") - cut) - F.greatest(F.col("_from"), cut)
    some = counted(df, value, by).withColumn("_kept", kept).where("_kept > 0")
    return some.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_kept")) / F.sum("_kept")).alias("trimmed"))


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows without nulls, means, mean products) of a few columns, in one pass."""
    df = df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*"), *[F.avg(F.col(c).cast("double")) for c in columns], *[F.avg(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")) for i, j in pairs]).first()
    k = len(columns)
    products = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :], strict=True):
        products[i, j] = products[j, i] = v if v is not None else np.nan
    return row[0], np.array([np.nan if v is None else v for v in row[1 : 1 + k]], float), products


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each ordered pair of columns, over rows without nulls."""
    df = df.dropna(subset=columns)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): variance inflation factors, from the triangular factor of the columns with an intercept; infinite for sums of others."""
    from kernelweave.operators import tsqr

    found = tsqr.inflation(tsqr.r_factor(df.dropna(subset=columns), [F.lit(1.0), *[F.col(c) for c in columns]]))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, found, strict=True)], "column string, vif double")


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    half = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - half if t > 0 else half


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def yuen_dependent(df: DataFrame, a: str, b: str, by: list[str], percent: float = 20.0, alpha: float = 0.05) -> DataFrame:
    """Yuen's dependent trimmed t-test of a against b for each group: (by.., t, diff, se, df, n, p, lo, hi).

    Places come from counted values in ranges, winsorised sums are aggregates; groups of fewer than 4 kept pairs give no row.
    """
    df = df.dropna(subset=[a, b])
    share = F.floor(F.col("_all") * F.lit(percent / 100.0))
    r = df
    for c, k in ((a, "_a"), (b, "_b")):
        at = counted(df, c, by).withColumn("_g", share)
        lo, hi = F.col("_g") + 1, F.col("_all") - F.col("_g")
        kept = F.greatest(F.least(F.col("_to"), hi) - F.greatest(F.col("_from"), F.col("_g")), F.lit(0))
        ends = at.groupBy(*[F.col(x).alias(f"{k}by{i}") for i, x in enumerate(by)]).agg(
            F.max(F.when((F.col("_from") < lo) & (lo <= F.col("_to")), F.col("_x"))).alias(k + "lo"), F.max(F.when((F.col("_from") < hi) & (hi <= F.col("_to")), F.col("_x"))).alias(k + "hi"),
            (F.sum(F.col("_x") * kept) / F.sum(kept)).alias(k + "t"), F.first("_all").alias(k + "n"), F.first("_g").alias(k + "g"),
        )
        r = r.join(ends, reduce(and_, [F.col(x).eqNullSafe(F.col(f"{k}by{i}")) for i, x in enumerate(by)]))
        r = r.withColumn(k + "w", F.least(F.greatest(F.col(c), F.col(k + "lo")), F.col(k + "hi")))
    g = r.groupBy(*by).agg(F.first("_an").alias("n"), F.first("_ag").alias("_g"), F.first("_at").alias("ma"), F.first("_bt").alias("mb"), F.var_samp("_aw").alias("va"), F.var_samp("_bw").alias("vb"), F.covar_samp("_aw", "_bw").alias("cov"))
    h = F.col("n") - 2 * F.col("_g")
    g = g.where(h >= 4).withColumn("df", (h - 1).cast("double"))
    n1 = F.col("n") - 1
    g = g.withColumn("se", F.sqrt(((F.col("va") + F.col("vb") - 2 * F.col("cov")) * n1) / (h * (h - 1)))).withColumn("diff", F.col("ma") - F.col("mb"))
    g = g.withColumn("t", F.col("diff") / F.col("se"))
    p_of = F.udf(lambda t, d: 2 * (1 - t_cdf(abs(t), d)) if t is not None else None, "double")  # one row for each group
    q_of = F.udf(lambda d: t_quantile(1 - alpha / 2, d), "double")
    g = g.withColumn("p", p_of("t", "df")).withColumn("_q", q_of("df"))
    return g.select(*by, "t", "diff", "se", "df", "n", "p", (F.col("diff") - F.col("_q") * F.col("se")).alias("lo"), (F.col("diff") + F.col("_q") * F.col("se")).alias("hi"))
