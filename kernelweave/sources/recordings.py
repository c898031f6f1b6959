"""Signals and events as tables: readers, the driver's tables as recordings, sinks, old column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.functions.stats import no_nan
from kernelweave.session import ship

SAMPLES = "recording_id string, t bigint, channel int, y double"
EVENTS = "recording_id string, event_index bigint, type string, latency double"
START, STEP_S, N_SAMPLES = "2024-01-01 00:00:00", 60, 43_200


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """An empty recording: (samples, events)."""
    return spark.createDataFrame([], SAMPLES), spark.createDataFrame([], EVENTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_signal(df: DataFrame, time: str = "t", recording: str | None = None) -> DataFrame:
    """A wide signal (a column for each channel) as samples; NaN becomes null."""
    keys = [c for c in (time, recording) if c]
    channels = [c for c in df.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("channel"), no_nan(F.col(c).cast("double")).alias("y")) for i, c in enumerate(channels)])
    rec = F.col(recording) if recording else F.lit("r")
    return df.select(rec.cast("string").alias("recording_id"), F.col(time).cast("long").alias("t"), F.inline(cells))


def read_events(df: DataFrame, type_: str, latency: str, index: str, recording: str | None = None) -> DataFrame:
    """Events with their covariates: booleans become numbers, NaN null."""
    rest = [c for c in df.columns if c not in (type_, latency, index, recording)]
    kinds = dict(df.dtypes)

    def clean(c: str):
        x = F.col(c)
        return (x.cast("double") if kinds[c] == "boolean" else no_nan(x) if kinds[c] in ("double", "float") else x).alias(c)

    return df.select((F.col(recording) if recording else F.lit("r")).cast("string").alias("recording_id"), F.col(index).cast("long").alias("event_index"), F.col(type_).alias("type"), F.col(latency).cast("double").alias("latency"), *map(clean, rest))


def model_events(spark: SparkSession, sf_dir: str, recordings: int = 4) -> DataFrame:
    """The events table as model events: a sample each minute, users dealt to recordings."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(START).cast("timestamp"))
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % recordings).cast("string")).alias("recording_id"),
        F.col("event_id").alias("event_index"), F.col("event_type").alias("type"), (micros / F.lit(STEP_S * 1e6) + 1).alias("latency"),
        no_nan(F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        ((micros / F.lit(3.6e9)) % 24).alias("hour"), (F.col("user_id") % 3).cast("double").alias("grp"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-channel signal over the same minutes: events in each, and the sum of their values."""
    e = model_events(spark, sf_dir).withColumn("t", F.round("latency").cast("long")).where(F.col("t").between(1, N_SAMPLES))
    sums = e.groupBy("recording_id", "t").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    every = e.select("recording_id").distinct().select("recording_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_SAMPLES).cast("long"))).alias("t"))
    wide = every.join(sums, ["recording_id", "t"], "left").select("recording_id", "t", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return read_signal(wide, "t", "recording_id")


def tidy(curves: DataFrame, metadata: DataFrame, method: str = "deconv", channels: list[int] | None = None) -> DataFrame:
    """(event, predictor, predictorvalue, channel, time, data, method); channels without data go."""
    m = metadata.select("col_id", F.array_join("event_types", " ").alias("event"), F.col("variable").alias("predictor"), F.col("value").alias("predictorvalue"))
    out = curves.join(F.broadcast(m), "col_id")  # one row for each model column
    if channels is not None:
        out = out.where(F.col("channel").isin(*channels))
    live = out.groupBy("channel").agg(F.count("beta").alias("_n")).where("_n > 0").select("channel")
    return out.join(F.broadcast(live), "channel").select("event", "predictor", "predictorvalue", "channel", F.col("time_s").alias("time"), F.col("beta").alias("data"), F.lit(method).alias("method"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).csv(path if path.endswith(".csv") else path + ".csv")


def migrate(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames columns of older files by names {old: new}; a name that is already there is left."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})
