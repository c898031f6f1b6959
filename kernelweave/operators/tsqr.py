"""The triangular factor of a tall matrix: each task factors its blocks, and factors are stacked and factored again.

X'X squares the condition number, so that columns alike to 1e-8 look equal in it; the factor R of X = QR does not. It
has columns x columns numbers whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import packed

#: Tasks that take the factors of all others before the driver takes theirs.
STACKS = 16


def _folded(p: int):
    """Stacks blocks (or factors) of p columns and keeps the factor of what it has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            for x in b.column(0):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(x.as_buffer()).reshape(-1, p)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["x"])

    return of


def r_factor(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """R (at most columns x columns) of the rows without nulls or NaN."""
    p = len(columns)
    rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    blocks = packed.blocks(rows, {"x": [F.col(c) for c in rows.columns]}).select("x")
    parts = blocks.mapInArrow(_folded(p), "x binary").repartition(STACKS).mapInArrow(_folded(p), "x binary").collect()
    found = [np.frombuffer(r["x"]).reshape(-1, p) for r in parts]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, p))


def rank(r: np.ndarray, tol: float | None = None) -> int:
    """Of the matrix behind R, columns scaled to norm 1; tol: singular values below tol times the largest count as 0."""
    size = np.sqrt((r * r).sum(0))
    if not size.any():
        return 0
    values = np.linalg.svd(r[:, size > 0] / size[size > 0], compute_uv=False)
    return int((values > (tol if tol is not None else max(r.shape[1], 100) * np.finfo(float).eps) * values[0]).sum())


def inflation(r: np.ndarray) -> np.ndarray:
    """Variance inflation factors of all columns but the first, the intercept, from R; infinite where a column is a sum of others."""
    centred = r[1:, 1:]
    p = centred.shape[1]
    if len(centred) < p:
        return np.full(p, np.inf)
    size = np.sqrt((centred * centred).sum(0))
    scaled = centred / np.where(size > 0, size, 1.0)
    u, s, vt = np.linalg.svd(scaled)
    small = s <= max(p, 1000) * np.finfo(float).eps * s[0]
    inverse = (vt / np.where(small, 1.0, s)[:, None]) ** 2
    inverse[small] = 0.0
    out = inverse.sum(0)
    # a null vector that a column takes part in makes its factor infinite
    out[(np.abs(vt[small]) > 1e-8).any(0)] = np.inf
    return np.where(size > 0, out, np.inf)
