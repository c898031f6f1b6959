"""Sums over risk sets: the partial likelihood of survival times with Breslow ties, its slope and curvature.

Rows are range-partitioned by time once and packed into blocks in that order; rows of one time may span blocks, so a
time that many rows share is no task of its own. A step is three passes over the blocks. The first sums each block's
weights exp(eta) and their products with the columns; from these follows what every block adds to its own running sums, the
risk set of later blocks. The second sums events over risk, the steps of the cumulative hazard; the third takes each row at its
cumulative hazard for slope and curvature. The driver sees 2 (columns + 1) numbers a block and model.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import packed


def carried(first: np.ndarray, last: np.ndarray, total: np.ndarray, at_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block in order: the sums of all later blocks, and of earlier blocks' rows at this block's first time."""
    later = np.cumsum(total[::-1], 0)[::-1] - total
    tied, time, run = np.zeros_like(total), None, np.zeros_like(total[0])
    for i in range(len(first)):
        if time == first[i]:
            tied[i] = run
        run = run + at_last[i] if time == last[i] else at_last[i]
        time = last[i]
    return later, tied


def hazards(first: np.ndarray, last: np.ndarray, total: np.ndarray, at_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block in order: the steps of all earlier blocks, and later blocks' steps at this block's last time."""
    before = np.cumsum(total, 0) - total
    tied, time, run = np.zeros_like(total), None, np.zeros_like(total[0])
    for i in range(len(first) - 1, -1, -1):
        if time == last[i]:
            tied[i] = run
        run = run + at_first[i] if time == first[i] else at_first[i]
        time = first[i]
    return before, tied


class RiskSets:
    """Rows in order of time; time and status (1: the event happened) are the outcome."""

    def __init__(self, df: DataFrame, columns: list[str], time: str, status: str, weight: Column, offset: Column, fold: Column):
        self.p, self.k = len(columns), 1
        self.width = {"x": self.p, "y": 2, "wof": 3}
        df = df.withColumn("_row", F.monotonically_increasing_id())
        groups = {"x": [F.col(c) for c in columns], "y": [F.col(time), F.col(status)], "wof": [weight, offset, fold]}
        self.table = packed.stored(packed.blocks(df, groups, [F.col(time).cast("double"), F.xxhash64("_row")]), "risk_sets")
        ties = df.where(F.col(status) > 0).groupBy(time).agg(F.sum(weight * F.col(status)).alias("d"))
        self.least = ties.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d") * F.log("d"))), F.lit(0.0))).first()[0]

    def _of_blocks(self, of) -> dict[int, np.ndarray]:
        """of(block) -> an array for each block."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in packed.unpacked(batch, width):
                    yield pa.RecordBatch.from_arrays([pa.array([b["block"]], pa.int64()), pa.array([of(b).tobytes()], pa.binary())], ["block", "v"])

        got = self.table.mapInArrow(run, "block long, v binary").collect()
        return {r["block"]: np.frombuffer(r["v"]) for r in got}

    def start(self) -> dict[int, dict[str, np.ndarray]]:
        """Of each fold: sums of w, x, x^2, events, and the number of rows."""
        p = self.p

        def of(b):
            for f in np.unique(b["wof"][:, 2]):
                at = b["wof"][:, 2] == f
                w, x = b["wof"][at, 0], b["x"][at]
                yield int(f), np.concatenate([[w.sum()], w @ x, w @ (x * x), [w @ b["y"][at, 1], float(at.sum())]])

        got = packed.sums(self.table, self.width, of)
        out = {f: {"w": v[0], "x": v[1 : 1 + p], "xx": v[1 + p : 1 + 2 * p], "y": v[-2:-1], "n": v[-1], "least": 0.0} for f, v in got.items()}
        if out:
            # of the whole table; no part of it is a sum over rows
            out[min(out)]["least"] = self.least
        return out

    def steps(self, models: list) -> None:
        """Gives every model (loss, falling gradient of all columns, curvature of those in play), each divided by the weights."""
        sc, p = self.table.sparkSession.sparkContext, self.p
        jobs = [(m.fold, m.b[1:, 0], m.play - 1) for m in models]

        def risks(b):
            """Of each model the weights, and w exp(eta), of a block's rows; where each time begins; the row's time by number."""
            w, off, fold = b["wof"].T
            eta = b["x"] @ np.column_stack([j[1] for j in jobs]) + off[:, None]
            wm = np.column_stack([np.where(fold == j[0], 0.0, w) for j in jobs])
            t = b["y"][:, 0]
            begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            return wm, wm * np.exp(np.minimum(eta, 50.0)), eta, begins, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(t))))

        def totals(b):
            _, e, _, begins, _ = risks(b)
            x = np.column_stack([np.ones(len(b["x"])), b["x"]])
            return np.concatenate([b["y"][[0, -1], 0], (e.T @ x).ravel(), (e[begins[-1] :].T @ x[begins[-1] :]).ravel()])

        got = self._of_blocks(totals)
        order = sorted(got)
        table = np.array([got[i] for i in order])
        first, last, sums = table[:, 0], table[:, 1], table[:, 2:].reshape(len(order), 2, len(jobs), 1 + p)
        later, tied = carried(first, last, sums[:, 0], sums[:, 1])
        place = {b: i for i, b in enumerate(order)}
        risk = sc.broadcast((place, later, tied))

        def reached(z, begins):
            """Of each time of a block the sum of its and all later rows."""
            return np.cumsum(z[::-1], 0)[::-1][begins]

        def steps_of(b):
            """Of each time and model: the step of the cumulative hazard, the risk set's sum, the events."""
            wm, e, _, begins, _ = risks(b)
            i = risk.value[0][b["block"]]
            s = reached(e, begins) + risk.value[1][i, :, 0]
            s[0] += risk.value[2][i, :, 0]
            d = np.add.reduceat(wm * b["y"][:, 1:2], begins)
            return np.where(d > 0, d / np.where(s > 0, s, 1.0), 0.0), s, d

        def events(b):
            a, _, _ = steps_of(b)
            return np.concatenate([a.sum(0), a[0]])

        got = self._of_blocks(events)
        a = np.array([got[i] for i in order]).reshape(len(order), 2, len(jobs))
        before, after = hazards(first, last, a[:, 0], a[:, 1])
        hazard = sc.broadcast((before, after))

        def of(b):
            wm, e, eta, begins, number = risks(b)
            a, s, d = steps_of(b)
            i = risk.value[0][b["block"]]
            up = np.cumsum(a, 0) + hazard.value[0][i]
            up[-1] += hazard.value[1][i]
            own = e * up[number]  # w exp(eta) x cumulative hazard
            x, happened = b["x"], wm * b["y"][:, 1:2]
            for j, (_, _, play) in enumerate(jobs):
                loss = (d[:, j] * np.log(np.where(s[:, j] > 0, s[:, j], 1.0))).sum() - happened[:, j] @ eta[:, j]
                grad = (happened[:, j] - own[:, j]) @ x
                xs = x[:, play]
                h = xs.T @ (xs * own[:, j : j + 1])
                if len(play):
                    s1 = reached(e[:, j : j + 1] * xs, begins) + risk.value[1][i, j, 1 + play]
                    s1[0] += risk.value[2][i, j, 1 + play]
                    ratio = s1 * np.where(d[:, j] > 0, np.sqrt(d[:, j]) / np.where(s[:, j] > 0, s[:, j], 1.0), 0.0)[:, None]
                    h = h - ratio.T @ ratio
                yield j, np.concatenate([[wm[:, j].sum(), loss, 0.0], grad, h.ravel()])

        got = packed.sums(self.table, self.width, of)
        for j, m in enumerate(models):
            v, q = got[j], len(m.play)
            m.sums = v[1] / v[0], v[2 : 3 + p].reshape(-1, 1) / v[0], v[3 + p :].reshape(q, q) / v[0]
            m.weight = v[0]
        risk.unpersist()
        hazard.unpersist()

    def held_out(self, models: list) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """Of each model the events of its fold, and twice the loss of all rows less that of the rows it saw."""
        start, none = self.start(), np.zeros(0, np.int64)
        pairs = [SimpleNamespace(fold=f, b=m.b, play=none) for m in models for f in (-1, m.fold)]
        self.steps(pairs)
        out = []
        for i, m in enumerate(models):
            whole, seen = (pairs[2 * i + j].sums[0] * pairs[2 * i + j].weight for j in (0, 1))
            out.append((float(start[m.fold]["y"][0]), np.array([2 * (whole - seen), 0.0, 0.0, 0.0]), np.zeros(4), float(start[m.fold]["n"])))
        return out
