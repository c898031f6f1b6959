"""Tables ready to be drawn: baselines, images, topographies, group means, histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.functions.stats import hazen, no_nan, running, trimmed_mean
from kernelweave.operators.design import Design
from kernelweave.operators.postfit import marginal, predict


def baseline(curves: DataFrame, lo_s: float, hi_s: float, keys: list[str]) -> DataFrame:
    """beta less its mean over lo_s <= time_s < hi_s, for each group of keys."""
    inside = F.avg(F.when((F.col("time_s") >= lo_s) & (F.col("time_s") < hi_s), F.col("beta"))).over(W.partitionBy(*keys))
    return curves.withColumn("beta", F.col("beta") - F.coalesce(inside, F.lit(0.0)))


def with_intercept(curves: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds the intercept of the same event set to every other column."""
    m = metadata.select("col_id", "name", "kind", F.array_join(F.array_sort("event_types"), " ").alias("set"))
    c = curves.join(F.broadcast(m), "col_id")
    base = c.where("kind = 'intercept'").select("channel", "lag", "set", F.col("beta").alias("_b"))
    return c.join(base, ["channel", "lag", "set"], "left").withColumn("beta", F.when(F.col("kind") == "intercept", F.col("beta")).otherwise(F.col("beta") + F.coalesce("_b", F.lit(0.0)))).drop("_b")


def curve_table(curves: DataFrame, metadata: DataFrame, window_s: tuple[float, float] | None = None, add_intercept: bool = False) -> DataFrame:
    """(event, predictor, value, label, channel, time_s, beta [, set]): all curves as one table, less their mean over window_s, with or without their set's intercept."""
    sets = ["set"] if "set" in curves.columns else []
    c = baseline(curves, *window_s, ["channel", "col_id", *sets]) if window_s else curves
    m = F.broadcast(metadata.select("col_id", "name", "kind", "variable", "value", F.array_join(F.array_sort("event_types"), " ").alias("event")))  # one row for each model column
    c = c.join(m, "col_id")
    if add_intercept:
        base = c.where("kind = 'intercept'").select("channel", "lag", "event", *sets, F.col("beta").alias("_b"))
        c = c.join(base, ["channel", "lag", "event", *sets], "left").withColumn("beta", F.col("beta") + F.when(F.col("kind") == "intercept", 0.0).otherwise(F.coalesce("_b", F.lit(0.0))))
    return c.select("event", F.col("variable").alias("predictor"), "value", F.col("name").alias("label"), "channel", "time_s", "beta", *sets)


def parameter_table(curves: DataFrame, design: Design, at: dict[str, list[float]] | None = None, add_intercept: bool = False, add_marginal: str | None = None, window_s: tuple[float, float] | None = None, channels: list[int] | None = None, variables: list[str] | None = None) -> DataFrame:
    """(event, predictor, value, value2, label, channel, time_s, beta [, set]): predicted curves, splines and continuous variables at values.

    at: values of some variables (10 quantiles). add_marginal MEM or AME adds the other variables of the set (then no intercept is added, as it is one
    of them); window_s takes off the mean over a window first; channels and variables choose among curves.
    """
    if add_intercept and add_marginal:
        raise ValueError("the marginals hold the intercept")
    sets = ["set"] if "set" in curves.columns else []
    c = curves if channels is None else curves.where(F.col("channel").isin(*channels))
    c = baseline(c, *window_s, ["channel", "col_id", *sets]) if window_s else c
    table = predict(c, design, at)
    if add_marginal:
        table = marginal(table, c, design, add_marginal)
    table = table.withColumn("event", F.array_join(F.array_sort("event_types"), " "))
    if add_intercept:
        base = table.where("kind = 'intercept'").select("channel", "lag", "event", *sets, F.col("beta").alias("_b"))
        table = table.join(base, ["channel", "lag", "event", *sets], "left").withColumn("beta", F.col("beta") + F.when(F.col("kind") == "intercept", 0.0).otherwise(F.coalesce("_b", F.lit(0.0))))
    if variables is not None:
        table = table.where(F.col("variable").isin(*variables))
    label = F.concat_ws(": ", "variable", F.concat_ws(", ", F.format_string("%.4g", "value"), F.when(F.col("value2").isNotNull(), F.format_string("%.4g", "value2"))))
    return table.select("event", F.col("variable").alias("predictor"), "value", "value2", F.when(F.col("value").isNull(), F.col("variable")).otherwise(label).alias("label"), "channel", "time_s", "beta", *sets)


def value_image(curves: DataFrame, design: Design, variable: str, n: int = 100, add_intercept: bool = False, add_marginal: str | None = None, window_s: tuple[float, float] | None = None, channels: list[int] | None = None) -> DataFrame:
    """parameter_table of one variable at n values from its least to its largest: the cells of a value x time image."""
    columns = [c for c in design.columns if c.variable == variable]
    if not columns or columns[0].kind not in ("continuous", "spline"):
        raise ValueError(f"{variable} is no continuous variable of the design")
    of = list(design.splines[variable].spec.variables) if variable in design.splines else [variable if variable in design.events.columns else variable.split("_", 1)[-1]]
    mine = design.events.where(F.col("type").isin(*columns[0].event_types))
    ends = mine.agg(*[f(no_nan(F.col(v).cast("double"))) for v in of for f in (F.min, F.max)]).first()
    at = {v: np.linspace(ends[2 * i], ends[2 * i + 1], n if len(of) == 1 else max(2, round(n**0.5))).tolist() for i, v in enumerate(of)}
    at |= {variable: at[of[0]]} if len(of) == 1 else {}
    return parameter_table(curves, design, at, add_intercept, add_marginal, window_s, channels, [variable])


def display_window(xdc: DataFrame, events: DataFrame, srate: float, seconds: float = 60.0) -> DataFrame:
    """xdc within seconds / 2 of the middle event of each recording (of the times of its events), for a picture of it."""
    from kernelweave.operators.postfit import _ranked

    times = _ranked(events.select("recording_id", F.round("latency").cast("long").alias("t")))
    middle = times.where(F.col("place") == F.greatest(F.round(F.col("of") / 2) - 1, F.lit(0))).select("recording_id", F.col("t").alias("_mid"))
    return xdc.join(middle, "recording_id").where(F.abs(F.col("t") - F.col("_mid")) < F.lit(seconds * srate / 2)).drop("_mid")


def image(predicted: DataFrame, variable: str) -> DataFrame:
    """value x lag cells of one variable."""
    return predicted.where(F.col("variable") == variable).groupBy("channel", "value", "lag").agg(F.avg("beta").alias("beta"))


def topographies(curves: DataFrame, n: int = 15) -> DataFrame:
    """Mean of each column in n time slices and the symmetric 5/95 limits of its colours."""
    span = curves.agg(F.min("lag").alias("a"), F.max("lag").alias("b"))
    c = curves.crossJoin(F.broadcast(span)).withColumn("slice", F.floor((F.col("lag") - F.col("a")) * n / (F.col("b") - F.col("a") + 1)))  # one row
    means = c.groupBy("col_id", "channel", "slice").agg(F.avg("beta").alias("beta"))
    q = hazen(means, "beta", [0.05, 0.95], ["col_id"]).groupBy("col_id").agg(F.max(F.abs("q")).alias("limit"))
    return means.join(q, "col_id")


def group_mean(effects: DataFrame, keys: list[str], percent: float = 20.0, plain: bool = False) -> DataFrame:
    """Across recordings: the trimmed (or plain) mean of beta for each cell."""
    return effects.groupBy(*keys).agg(F.avg("beta").alias("trimmed")) if plain else trimmed_mean(effects, "beta", keys, percent)


def bootstrap_ci(effects: DataFrame, keys: list[str], draws: int = 200, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(keys.., lo, hi): Poisson bootstrap of the mean over recordings, seeded by recording and draw."""
    u = F.xxhash64(F.lit(seed), "recording_id", "draw") / F.lit(2.0**64) + 0.5
    weight = F.when(u < 0.3678794, 0).when(u < 0.7357589, 1).when(u < 0.9196986, 2).when(u < 0.9810118, 3).when(u < 0.9963402, 4).otherwise(5)
    d = effects.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", weight)
    m = d.groupBy(*keys, "draw").agg((F.sum(F.col("beta") * F.col("_w")) / F.sum("_w")).alias("m"))
    q = hazen(m, "m", [alpha / 2, 1 - alpha / 2], keys)
    return q.groupBy(*keys).agg(F.min("q").alias("lo"), F.max("q").alias("hi"))


def histogram(events: DataFrame, variable: str, bins: int = 20) -> DataFrame:
    """(bin, n): equal-width bins of a numeric variable, the last closed; nulls are left out."""
    x = events.where(F.col(variable).isNotNull()).select(F.col(variable).cast("double").alias("x"))
    span = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    b = x.crossJoin(F.broadcast(span))  # one row
    return b.select(F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def level_counts(events: DataFrame, variable: str) -> DataFrame:
    """(level, n): events of each value of a categorical variable; nulls are left out."""
    return events.where(F.col(variable).isNotNull()).groupBy(F.col(variable).cast("string").alias("level")).agg(F.count("*").alias("n"))


def density(events: DataFrame, variable: str, points: int = 50, bins: int = 400) -> DataFrame:
    """(x, density): a Gaussian kernel over finely binned values, Silverman's width; its cost does not grow with rows."""
    x = events.where(F.col(variable).isNotNull()).select(F.col(variable).cast("double").alias("x"))
    s = F.broadcast(x.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.stddev_samp("x").alias("s"), F.count("*").alias("n")))
    cells = x.crossJoin(s).groupBy(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins).alias("cell")).agg(F.avg("x").alias("c"), F.count("*").alias("w"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("s").alias("s"), F.first("n").alias("n"))
    h = 1.06 * F.col("s") * F.pow(F.col("n"), F.lit(-0.2))
    at = cells.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("p") / (points - 1))
    g = F.exp(-F.pow((F.col("x") - F.col("c")) / h, F.lit(2.0)) / 2) / (h * 2.5066282746310002)
    return at.groupBy("x").agg((F.sum(F.col("w") * g) / F.first("n")).alias("density"))


def design_image(wide: DataFrame, columns: list[str], sort: bool = True) -> DataFrame:
    """(row, column, signed_log) of a design; rows in order of its columns."""
    keys = [F.col(f"`{c}`") for c in columns] if sort else [F.col("event_index")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.signum(F.col(f"`{c}`")) * F.log1p(F.abs(F.col(f"`{c}`")))).alias("signed_log")) for c in columns])
    return wide.withColumn("row", F.row_number().over(W.partitionBy("recording_id").orderBy(*keys, "event_index"))).select("recording_id", "row", F.inline(cells))


def neighbours(channels: DataFrame, radius: float) -> DataFrame:
    """(channel, neighbour) nearer than radius: cells of that size, joined with those around."""
    def cell(c):
        return F.floor(F.col(c) / radius)

    a = channels.select("channel", "x", "y", "z", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    step = F.sequence(F.lit(-1), F.lit(1))
    b = a.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("dz", F.explode(step))
    b = b.select(F.col("channel").alias("neighbour"), *[F.col(c).alias("n" + c) for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in "xyz"])
    d = sum((F.pow(F.col(c) - F.col("n" + c), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return a.join(b, ["cx", "cy", "cz"]).where((F.sqrt(d) < radius) & (F.col("channel") != F.col("neighbour"))).select("channel", "neighbour").distinct()


def insert_rows(df: DataFrame, new: DataFrame, order: str, after: str) -> DataFrame:
    """df with rows of new after the places that its column `after` names; places are dealt again from 1."""
    a = df.withColumn("_o", F.col(order).cast("double"))
    b = new.withColumn("_o", F.col(after) + 0.5).drop(after)
    both = a.drop(order).unionByName(b, allowMissingColumns=True)
    if "recording_id" in both.columns:
        return both.withColumn(order, F.row_number().over(W.partitionBy("recording_id").orderBy("_o"))).drop("_o")
    # rows of one place: those before it, and their own order
    places = running(both.groupBy("_o").agg(F.count("*").alias("_n")), "_o", "_n").select("_o", (F.col("_to") - F.col("_n")).alias("_first"))
    mine = F.row_number().over(W.partitionBy("_o").orderBy(*[c for c in both.columns if c != "_o"]))
    return both.withColumn("_k", mine).join(places, "_o").withColumn(order, (F.col("_first") + F.col("_k")).cast("int")).drop("_o", "_k", "_first")


def merge_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """All events of both, with the fields of either."""
    return a.unionByName(b, allowMissingColumns=True)


def weighted_auc(df: DataFrame, score: str, label: str, weight: str) -> DataFrame:
    """(auc): the weighted chance that a positive scores above a negative; ties count half. From sums by distinct score."""
    w = F.col(weight).cast("double")
    s = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("n"))
    return running(s.where("_s is not null"), "_s", "n").withColumn("_b", F.col("_to") - F.col("n")).agg((F.sum(F.col("p") * (F.col("_b") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
