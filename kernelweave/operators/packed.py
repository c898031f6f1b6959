"""Dense numbers in binary columns: rows packed into blocks, and sums of packed arrays in a tree.

A table of blocks is written once to the shared folder (`spark.checkpoint.dir`), so that the passes of a fit neither
recompute the rows nor depend on one executor. Sums are added up inside every task first and then by key: what a
key's task receives is one array from each task before it, and it holds one array for each of its keys.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of a block's largest column.
BLOCK_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new temporary folder only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `stored` made."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The triangle R of a QR of two such triangles' rows, each m x m in one array."""
    m = int(round(len(a) ** 0.5))
    return triangle(np.concatenate([a.reshape(m, m), b.reshape(m, m)])).ravel()


def triangle(z: np.ndarray) -> np.ndarray:
    """R of a QR of rows, m x m also where there are fewer rows: R'R is z'z, without squaring its condition."""
    r = np.linalg.qr(z, "r")
    return np.concatenate([r, np.zeros((z.shape[1] - len(r), z.shape[1]))])


def _added(keys: int, add):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for *key, v in zip(*[b.column(i).to_pylist() for i in range(keys + 1)], strict=True):
                v = np.frombuffer(v)
                had = sums.get(tuple(key))
                if had is None:
                    sums[tuple(key)] = v.copy()
                elif add is None:
                    had += v
                else:
                    sums[tuple(key)] = add(had, v)
        for key, v in sums.items():
            cols = [pa.array([k], schema.types[i]) for i, k in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tobytes()], pa.binary())], schema.names)

    return of


def summed(df: DataFrame, *keys: str, add=None) -> DataFrame:
    """(keys, v): sums of arrays of doubles (binary column v, one length for each key), inside tasks first, then by key. add joins two instead."""
    df = df.select(*keys, "v")
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(_added(len(keys), add), schema).repartition(*keys).mapInArrow(_added(len(keys), add), schema)


def sums(table: DataFrame, widths: dict[str, int], of) -> dict[int, np.ndarray]:
    """Of a table of blocks the sums of the (key, array) pairs that of(block) gives; few keys, whose sums the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in unpacked(batch, widths):
                for key, v in of(block):
                    total[key] = total[key] + v if key in total else v
        for key, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["key", "v"])

    got = summed(table.mapInArrow(run, "key int, v binary"), "key").collect()
    return {r["key"]: np.frombuffer(r["v"]) for r in got}


def blocks(df: DataFrame, groups: dict[str, list[Column]], order: list[Column] | None = None) -> DataFrame:
    """Rows as blocks: n, and for each group of columns a binary of n x columns doubles, row by row.

    order: range partitions in this order first; the column block then counts the blocks in order over the table.
    A block holds at most BLOCK_BYTES of its widest group.
    """
    widths = {g: len(c) for g, c in groups.items()}
    most = max(64, BLOCK_BYTES // (8 * max(1, *widths.values())))
    by = [f"_o{i}" for i in range(len(order or []))]
    flat = df.select(*[c.cast("double").alias(f"{g}_{i}") for g, cs in groups.items() for i, c in enumerate(cs)], *[c.alias(o) for c, o in zip(order or [], by, strict=True)])
    if by:
        flat = flat.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, serial, part = [], 0, 0, TaskContext.get().partitionId()

        def out(rows: np.ndarray) -> pa.RecordBatch:
            cols, at = [pa.array([(part << 32) + serial], pa.int64()), pa.array([len(rows)], pa.int32())], 0
            for w in widths.values():
                cols.append(pa.array([np.ascontiguousarray(rows[:, at : at + w]).tobytes()], pa.binary()))
                at += w
            return pa.RecordBatch.from_arrays(cols, ["block", "n", *widths])

        for b in batches:
            if b.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
                size += b.num_rows
            while size >= most:
                rows = np.concatenate(held)
                yield out(rows[:most])
                serial, held, size = serial + 1, [rows[most:]], size - most
        if size:
            yield out(np.concatenate(held))

    return flat.mapInArrow(packed, ", ".join(["block long", "n int", *[f"{g} binary" for g in widths]]))


def unpacked(batch: pa.RecordBatch, groups: dict[str, int]) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of a batch, each group as an n x width array."""
    for i in range(batch.num_rows):
        row = {"block": batch.column("block")[i].as_py()}
        for g, w in groups.items():
            row[g] = np.frombuffer(batch.column(g)[i].as_buffer()).reshape(-1, w)
        yield row
