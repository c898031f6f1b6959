"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source gets a share of the total in proportion to its weight; a source whose share would
pass max_epochs times its size is clamped there and the excess goes to the others by weight,
until none is above. A source's documents are then taken floor(target / size) times whole, and
a seeded part of them once more, so that the source's sum comes nearest to its target.

A null text or one without words has size 0 and is taken 0 words. Documents without source
form one source, last in order. Repeated rows are rows of their own; ties in the seeded order
are cut by the id, the size and the text's hash. A source of size 0 has target 0. No documents give no rows. Other columns
of the input, whatever their names, take no part.

A source may hold most rows, and so may one row that is repeated or rows without id: the seeded order, by a hash of id and text and then by
row, is cut into ranges of about equal size, range sums are added up per source, and only rows inside one range are ordered together.
Which of several equal rows is taken makes no difference, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.llm.common import unlike, written


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordered_by(df: DataFrame, *keys: Column) -> DataFrame:
    """df with a column place, 0.. over the whole table: range partitions, then places inside each."""
    parts = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    before = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return parts.withColumn("place", inside).join(F.broadcast(before), "_part").withColumn("place", F.col("place") + F.col("_before")).drop("_part", "_before")


def water_levels(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources(size, weight, ..) with target: shares of total by weight, none above max_epochs x size."""
    cap = F.col("size") * F.lit(max_epochs)
    free_total, free_weight = float(total), sources.agg(F.sum("weight")).first()[0] or 0.0
    level, was = 0.0, -1.0
    while free_weight > 0:
        level = free_total / free_weight
        if level <= was:
            break
        clamped = sources.where(cap <= F.col("weight") * F.lit(level)).agg(F.sum(cap), F.sum("weight"), F.count("*")).first()
        all_weight = sources.agg(F.sum("weight")).first()[0]
        free_total, free_weight, was = float(total) - (clamped[0] or 0.0), float(all_weight) - (clamped[1] or 0.0), level
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: list[float], text: str = "text", source: str = "source", doc_id: str = "doc_id", max_epochs: float = 3.0, total_share: float = 1.0, seed: int = 7, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, epochs, partial, taken) of each row of docs, and its column row if given.

    weights repeat over the sources in code point order, null last. epochs: whole takes of the
    document, partial: whether the seeded extra part has it; taken = size x (epochs + partial).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("of_text"), *([F.col(row).alias("row")] if row else []))
    rows = written(rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "of_text")).withColumn("serial", F.monotonically_increasing_id()), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources = written(ordered_by(sources, F.col("source").isNull(), F.col("source")), "sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    total = (sources.agg(F.sum("size")).first()[0] or 0) * total_share
    sources = water_levels(sources.withColumn("weight", weight), total, max_epochs)
    sources = sources.select(
        "source", F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).alias("epochs"),
    ).withColumn("extra", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # the seeded order: ranges of the hash, the row last
    keys = ["draw", "doc_id", "size", "of_text", "serial"]
    rows = written(rows.repartitionByRange("source", *keys).withColumn("range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("range_before", before).withColumnsRenamed({"source": "s", "range": "r"})
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["range"] == sums["r"])).drop("s", "r")
    inner = W.partitionBy("source", "range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    at = F.col("range_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    # a document is in the extra part if its middle is; then the one whose size comes nearest to what
    # the source misses, or has too much, changes sides
    rows = written(rows.withColumn("at", at).withColumn("partial", F.col("at") + F.col("size") / 2 < F.col("extra")), "partial")
    miss = rows.groupBy("source").agg((F.first("extra") - F.sum(F.when(F.col("partial"), F.col("size")).otherwise(0))).alias("miss"))
    near = F.abs(F.abs("miss") - F.col("size"))
    swap = rows.select("source", "doc_id", "size", "partial", "at").join(miss.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    swap = swap.where((F.col("partial") == (F.col("miss") < 0)) & (near < F.abs("miss")))
    swap = swap.groupBy("s").agg(F.min(F.struct(near.alias("near"), "at", "doc_id")).alias("best")).select("s", F.col("best.at").alias("swap_at"), F.col("best.doc_id").alias("swap_id"))
    rows = rows.join(swap, F.col("source").eqNullSafe(F.col("s")), "left")
    swapped = F.coalesce((F.col("at") == F.col("swap_at")) & F.col("doc_id").eqNullSafe(F.col("swap_id")) & (F.col("size") > 0) & F.col("swap_at").isNotNull(), F.lit(False))
    rows = rows.withColumn("partial", F.col("partial") != swapped)
    taken = F.col("size") * (F.col("epochs") + F.col("partial").cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "partial", taken.cast("long").alias("taken"), *([F.col("row").alias(row)] if row else []))


def repeated(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs as often as plan takes it; rows not taken go.

    docs has one row per id and none without (`mixed` takes any rows); of a document of size 0 one
    copy stays if its source is taken. Columns keep their names, whatever these are.
    """
    times = plan.select(F.struct(F.col(doc_id).alias("id"), (F.col("epochs") + F.col("partial").cast("long")).alias("n")).alias(unlike(docs, "plan")))
    of = F.col(unlike(docs, "plan"))
    out = docs.join(times, docs[doc_id] == of["id"]).where(of["n"] > 0)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), of["n"])).alias(unlike(docs, "copy"))
    return out.select(*[docs[c] for c in docs.columns], copy).select(*[docs[c] for c in docs.columns])


def mixed(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mix of any rows, those without id and repeated ones too: rows get a key of their own before the plan."""
    key = unlike(docs, "row_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    return repeated(keyed, mix(keyed, weights, row=key, **options), key).drop(key)
