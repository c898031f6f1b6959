"""Functions for SQL users: time expansion as a table function, custom spline bases as array functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="t bigint, lag int")
class TimeExpand:
    """time_expand(latency, lo, width): the samples that an event's window reaches."""

    def eval(self, latency: float, lo: int, width: int):
        if latency is not None:
            at = int(np.floor(abs(latency) + 0.5)) * (1 if latency >= 0 else -1)
            for k in range(width):
                yield at + lo + k, lo + k


def custom_basis(x: Column, function: Callable[[np.ndarray, np.ndarray], np.ndarray], knots: list[float]) -> Column:
    """array<double>: a user's basis (values, knots) -> rows of functions; null where x is null."""

    @F.arrow_udf("array<double>")
    def basis(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            v = x.to_numpy(zero_copy_only=False).astype(float)
            rows = function(v, np.array(knots, float))
            yield pa.array([None if np.isnan(a) else r.tolist() for a, r in zip(v, rows, strict=True)], pa.list_(pa.float64()))

    return basis(x)


def polynomial(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Powers 1.. up to the number of knots."""
    return np.stack([x ** (k + 1) for k in range(len(knots))], 1)


def register(spark: SparkSession) -> None:
    spark.udtf.register("time_expand", TimeExpand)
