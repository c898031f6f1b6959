"""Design matrices: formulas compiled to Column expressions over an event table.

A design is lazy: `Design.long` gives (recording_id, event_index, event_type, latency, col_id, x) with a
row for each event and column of its event types; events of other types have none. Missing
covariates stay null until imputed.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.functions import splines as sp
from kernelweave.functions.scan import scan
from kernelweave.functions.stats import hazen, moments, no_nan, quantiles
from kernelweave.operators import tsqr
from kernelweave.plans.formula import Formula, FormulaError, Spline, parse

KEYS = ["recording_id", "event_index", "type", "latency"]


@dataclass(frozen=True)
class DesignColumn:
    col_id: int
    name: str
    variable: str
    kind: str  # intercept, continuous, categorical, interaction, spline, trf, custom
    event_types: tuple[str, ...]
    expr: Column | None = None
    value: float | None = None  # a spline column's peak


@dataclass
class SplineFit:
    name: str
    spec: Spline
    knots: list[np.ndarray]
    dropped: int


@dataclass
class Design:
    events: DataFrame
    columns: list[DesignColumn]
    splines: dict[str, SplineFit] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)  # taken off under effects coding

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def wide(self) -> DataFrame:
        """Keys and one double column for each design column; 0 for events of other types."""
        return self.events.select(*KEYS, *[F.when(F.col("type").isin(*c.event_types), c.expr).otherwise(F.lit(0.0)).alias(c.name) for c in self.columns])

    def long(self) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c.col_id).alias("col_id"), F.col("type").isin(*c.event_types).alias("mine"), c.expr.cast("double").alias("x")) for c in self.columns])
        return self.events.select(*KEYS, F.inline(cells)).where("mine").drop("mine")

    def metadata(self) -> DataFrame:
        rows = [(c.col_id, c.name, c.variable, c.kind, list(c.event_types), c.value) for c in self.columns]
        return self.events.sparkSession.createDataFrame(rows, "col_id int, name string, variable string, kind string, event_types array<string>, value double")


#: Levels that a factor has at most: each becomes a column of the design.
MAX_LEVELS = 10_000


def levels(events: DataFrame, variable: str) -> list:
    """Distinct values, sorted; one small job for each factor. Raises beyond MAX_LEVELS, so that a column of ids never reaches the driver."""
    found = [r[0] for r in events.where(F.col(variable).isNotNull()).select(variable).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{variable} has over {MAX_LEVELS} values: no factor")
    return sorted(found)


def _label(value) -> str:
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value).lower() if isinstance(value, bool) else str(value)


def design(events: DataFrame, formulas: str | list[str], event_types: list[list[str]] | list[str], coding: str = "reference", categorical: dict[str, list] | None = None, spacing: str = "quantile", knots: dict[str, list[float]] | None = None, check_rank: bool = False) -> Design:
    """One formula for each set of event types.

    coding: reference (levels but the first), effects (sum to zero, continuous centred) or full.
    categorical: levels in order for some factors, reference first. spacing: quantile or linear.
    Raises for unknown variables, sets without events, factors of one level and events without a type. check_rank takes one
    pass over the events and warns of columns that are sums of others.
    """
    if coding not in ("reference", "effects", "full") or spacing not in ("quantile", "linear"):
        raise ValueError("unknown coding or spacing")
    texts = [formulas] if isinstance(formulas, str) else formulas
    sets = [list(event_types)] if event_types and isinstance(event_types[0], str) else [list(s) for s in event_types]
    if len(texts) != len(sets):
        raise ValueError("one formula for each set of event types")
    if not events.where("type is null or type = ''").isEmpty():
        raise ValueError("every event needs a type")
    used = {v for t in texts for v in parse(t).variables}
    if left := set(categorical or {}) - used:
        raise ValueError(f"levels of variables that no formula has: {sorted(left)}")
    out = Design(events, [])
    taken: set[str] = set()
    for k, (text, types) in enumerate(zip(texts, sets, strict=True), 1):
        _one(out, parse(text), tuple(types), coding, categorical or {}, spacing, knots or {}, k, taken)
    if check_rank:
        found, columns = rank(out)
        if found < columns:
            warnings.warn(f"the design has {columns} columns and rank {found}", stacklevel=2)
    return out


def _one(out: Design, f: Formula, types: tuple[str, ...], coding: str, orders: dict, spacing: str, given: dict, k: int, taken: set[str]) -> None:
    events = out.events
    missing = [v for v in f.variables if v not in events.columns]
    if missing:
        raise FormulaError(f"no variable {missing[0]} in the events")
    mine = events.where(F.col("type").isin(*types))
    if mine.isEmpty():
        raise ValueError(f"no event of {types}")
    dtypes = dict(events.dtypes)
    factors = {v for v in f.variables if v in f.categorical or dtypes[v] == "string"}
    if given_orders := {v for v in factors if v in orders}:
        unknown = {v: set(map(_label, orders[v])) - set(map(_label, levels(mine, v))) for v in given_orders}
        if any(unknown.values()):
            raise ValueError(f"no such level: {unknown}")
    coded: dict[str, list[tuple[str, Column]]] = {}
    for v in dict.fromkeys(x for t in f.terms for x in t):
        col = F.col(v)
        if v in factors:
            found = orders.get(v) or levels(mine, v)
            if len(found) < 2:
                raise ValueError(f"{v} has one value")
            base = found[-1] if coding == "effects" else found[0]
            shown = found if coding == "full" else [x for x in found if x != base]
            flat = -1.0 if coding == "effects" else 0.0
            coded[v] = [(f"{v}_{_label(x)}", F.when(col == F.lit(x), 1.0).when((col == F.lit(base)) if coding == "effects" else F.lit(False), flat).when(col.isNotNull(), 0.0)) for x in shown]
        else:
            x = no_nan(col.cast("double"))
            if mine.where(x.isNotNull()).select(x).distinct().limit(2).count() == 1:
                raise ValueError(f"{v} has one value")
            if coding == "effects":
                out.means[v] = mean = moments(mine.select(x.alias("x")), ["x"])[1][0]
                x = x - F.lit(float(mean))
            coded[v] = [(v, x)]
    parts: list[tuple[str, str, str, Column, float | None]] = []
    if f.intercept:
        parts.append(("(Intercept)", "(Intercept)", "intercept", F.lit(1.0), None))
    for term in f.terms:
        cells = [("", F.lit(1.0))]
        for v in term:
            cells = [(f"{a}:{n}" if a else n, x if not a else e * x) for n, x in coded[v] for a, e in cells]
        kind = "interaction" if len(term) > 1 else "categorical" if term[0] in factors else "continuous"
        parts += [(n, ":".join(term), kind, e, None) for n, e in cells]
    fits = [_spline(mine, s, spacing, given) for s in f.splines]
    for fit in fits:
        cols = sp.basis(fit.spec, fit.knots)
        peaks = _peaks(fit)
        parts += [(f"{fit.name}_{_short(peaks[i])}", fit.name, "spline", c, peaks[i][0]) for i, c in enumerate(cols) if i != fit.dropped]
    if not parts:
        raise FormulaError("a formula needs at least one column")
    variables = list(dict.fromkeys(p[1] for p in parts))
    clash = {v for x in variables for v in x.split(":") if v in taken}
    rename = {v: ":".join(f"{k}_{part}" if part in clash else part for part in v.split(":")) for v in variables}
    for name, variable, kind, expr, value in parts:
        if rename[variable] != variable:
            name = ":".join(f"{k}_{a}" if b in clash else a for a, b in zip(name.split(":"), variable.split(":"), strict=False))
        out.columns.append(DesignColumn(len(out.columns), name, rename[variable], kind, types, expr, value))
    for fit in fits:
        name = rename[fit.name]
        out.splines[name] = replace(fit, name=name)
    taken.update(v for x in variables for v in x.split(":"))


def _short(peak: tuple[float, ...]) -> str:
    def digits(v: float) -> str:
        places = max(0, 2 - int(np.floor(np.log10(abs(v)))) if v else 0)
        return f"{v:.{places}f}"

    return "_".join(map(digits, peak))


def _peaks(fit: SplineFit) -> list[tuple[float, ...]]:
    """Where each basis function is largest."""
    if fit.spec.function:
        g = np.linspace(fit.knots[0].min(), fit.knots[0].max(), 401)
        return [(float(v),) for v in g[sp.evaluate(fit.spec, fit.knots, g).argmax(0)]]
    grids = [np.linspace(k[0], k[-1], 401)[: 400 if fit.spec.kind == "circular" else 401] for k in fit.knots]
    one = [sp.circular_values(g, k, fit.spec.bounds) if fit.spec.kind == "circular" else sp.cubic_values(g, k) for g, k in zip(grids, fit.knots, strict=True)]
    tops = [g[b.argmax(0)] for g, b in zip(grids, one, strict=True)]
    return [(float(v),) for v in tops[0]] if len(tops) == 1 else [(float(a), float(b)) for b in tops[1] for a in tops[0]]


def _spline(events: DataFrame, s: Spline, spacing: str, given: dict[str, list[float]]) -> SplineFit:
    knots, centre = [], []
    for v in s.variables:
        x = events.select(no_nan(F.col(v).cast("double")).alias("x"))
        count = sp.knot_count(s.kind, s.n)
        if s.kind == "circular":
            lo, hi = s.bounds
            x = x.select((F.lit(lo) + F.pmod(F.col("x") - F.lit(lo), F.lit(hi - lo))).alias("x"))
        mean = x.agg(F.avg("x"), F.min("x"), F.max("x")).first()
        if mean[0] is None:
            raise ValueError(f"{v} has no value")
        if v in given:
            k = np.array(given[v], float)
        elif spacing == "linear":
            k = np.linspace(*((s.bounds) if s.kind == "circular" else mean[1:]), count)
        else:
            k = np.array(quantiles(x, "x", np.linspace(0, 1, count).tolist()))
        if s.kind == "circular":
            k[0], k[-1] = s.bounds
        if len(np.unique(k)) < 2:
            raise ValueError(f"{v} has too few values for a spline")
        knots.append(k)
        near = x.where("x is not null").agg(F.min_by("x", F.abs(F.col("x") - F.lit(float(mean[0]))))).first()[0]
        centre.append(np.array([near]))
    return SplineFit(s.name, s, knots, int(sp.evaluate(s, knots, *centre)[0].argmax()))


def add_spline(d: Design, variable: str, event_types: list[str], function: Callable, knots: list[float] | None = None, n: int | None = None, name: str | None = None) -> Design:
    """The design with one more basis over a variable: function(values, knots) gives rows of functions.

    Knots are given, or n of them stand at quantiles. The function that is largest at the value next to the mean goes, as for other splines.
    """
    if (knots is None) == (n is None):
        raise ValueError("knots or their number")
    types = tuple(event_types)
    x = d.events.where(F.col("type").isin(*types)).select(no_nan(F.col(variable).cast("double")).alias("x"))
    at = np.array(knots if knots is not None else quantiles(x, "x", np.linspace(0, 1, n).tolist()), float)
    mean = x.agg(F.avg("x")).first()[0]
    if mean is None or not len(at):
        raise ValueError(f"{variable} has no value")
    near = x.where("x is not null").agg(F.min_by("x", F.abs(F.col("x") - F.lit(float(mean))))).first()[0]
    label = name or variable
    if label in {c.variable for c in d.columns}:
        raise ValueError(f"the design has {label} already")
    spec = Spline("custom", (variable,), len(at), None, function)
    fit = SplineFit(label, spec, [at], int(sp.evaluate(spec, [at], np.array([near]))[0].argmax()))
    peaks = _peaks(fit)
    parts = [(f"{label}_{_short(peaks[i])}", c, peaks[i][0]) for i, c in enumerate(sp.basis(spec, [at])) if i != fit.dropped]
    more = [DesignColumn(len(d.columns) + k, text, label, "spline", types, c, value) for k, (text, c, value) in enumerate(parts)]
    return replace(d, columns=[*d.columns, *more], splines={**d.splines, label: fit})


def impute(long: DataFrame, method: str = "median", seed: int = 1) -> DataFrame:
    """Fills missing x of each column: mean, median, marginal (a seeded draw of its values), or drop (all rows of the event)."""
    if method == "drop":
        bad = long.where("x is null").select("recording_id", "event_index").distinct()
        return long.join(bad, ["recording_id", "event_index"], "left_anti")
    if method in ("mean", "median"):
        fill = long.groupBy("col_id").agg(F.avg("x").alias("_fill")) if method == "mean" else hazen(long, "x", [0.5], ["col_id"]).select("col_id", F.col("q").alias("_fill"))
        return long.join(fill, "col_id", "left").withColumn("x", F.coalesce("x", "_fill")).drop("_fill")
    if method != "marginal":
        raise ValueError(method)
    seen = long.where("x is not null")
    counts = seen.groupBy("col_id").agg(F.count("*").alias("_n"))
    draw = long.where("x is null").join(counts, "col_id", "left").withColumn("_k", F.pmod(F.xxhash64(F.lit(seed), "recording_id", "event_index", "col_id"), F.col("_n")) + 1)
    places = scan(seen, ["col_id"], ["event_index", "recording_id"], {"_k": ("sum", F.lit(1))})
    values = places.select("col_id", F.col("x").alias("_x"), (F.col("_k") + 1).alias("_k"))
    filled = draw.drop("x").join(values, ["col_id", "_k"], "left").withColumnRenamed("_x", "x").select(*long.columns)
    return seen.unionByName(filled)


def rank(design_: Design) -> tuple[int, int]:
    """(rank, columns) of the design, from its triangular factor."""
    wide = design_.wide()
    return tsqr.rank(tsqr.r_factor(wide, [F.col(f"`{c}`") for c in design_.names])), len(design_.columns)
