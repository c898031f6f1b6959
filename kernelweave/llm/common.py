"""Tables written to the shared folder, and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a new temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's switch for deleting a statement's shuffle files when it ends; else they stay until the driver's garbage collector finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement inside are deleted when it ends."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later readers depend on no executor. Shuffle files of the writing go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned and that no later job reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unlike(df: DataFrame, name: str) -> str:
    """A column name that df does not have (Spark's names do not tell case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows in an Arrow batch: whole texts may be long, and Python workers share an executor's memory.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Workers know the package, and Arrow batches are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches.

    Each round takes the smallest label among a vertex's neighbours, then the label of that
    label (pointer jumping), and is written to the shared folder. It ends when no label
    changes. Null ends are dropped; loops and repeated edges change nothing; no edges give
    no rows. Nothing is collected but the count of changes. A vertex with very many edges is one key of
    a join with the labels, whose partition adaptive execution splits.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = written(one.union(one.select("v", "u")).distinct(), "edges")
    labels = table = written(both.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        to = labels.select(F.col("id").alias("label"), F.col("component").alias("far"))
        new = written(step.join(to, "label").select("id", "was", F.least("label", "far").alias("component")), "labels")
        forget(table)
        table, labels = new, new.select("id", "component")
        if new.where("component <> was").isEmpty():
            forget(both)
            return labels


def fraction(*columns) -> F.Column:
    """A number from 0 to 1 that only the columns' values decide."""
    return (F.xxhash64(*columns) / F.lit(2.0**64)) + F.lit(0.5)
