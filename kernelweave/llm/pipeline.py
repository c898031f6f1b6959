"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents, and other columns of docs, whatever their names. Documents without
id pass the near-duplicate and passage stages unchanged; of repeated rows near_dedup keeps one. Null and
empty texts have no language, so language_id drops them; the later stages keep them. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm import bpe, langid, mixing, neardup, passages
from kernelweave.llm.common import prepare, table, unlike, written
from kernelweave.llm.queries import held_out, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected (no letter, or no known language) go."""
    prepare(spark)
    models = langid.fit(docs.where(~held_out(3, 1)))
    told = unlike(docs, "told")
    return docs.withColumn(told, langid.identify(F.col("text"), models, spark)).where(~F.col(told)["rejected"]).drop(told)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group whose 5-word shingles are 0.8 alike or more; of rows with one id and text one."""
    prepare(spark)
    kept = neardup.near_duplicates(docs, threshold_percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), F.lit(True).alias("kept")).distinct()
    kept = written(kept, "kept")
    rows = docs.join(kept, docs["doc_id"] == kept["id"], "left_semi")
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    many = written(ids.where("n > 1").select("id"), "many")
    if not many.isEmpty():
        again = rows.join(many, rows["doc_id"] == many["id"], "left_semi").dropDuplicates(["doc_id", "text"])
        rows = rows.join(many, rows["doc_id"] == many["id"], "left_anti").unionByName(again)
    return rows.unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; of which nothing else is left go."""
    prepare(spark)
    return passages.without(docs, written(passages.repeated_passages(docs), "passages"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources, weights 1, 2, 3 repeating, takes them."""
    return mixing.mixed(docs, [1, 2, 3])


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text again."""
    prepare(spark)
    both = bpe.round_trip(F.col("text"), tokenizer_path(), most=100_000)  # workers hold the other stages' memory too
    out = docs.select("doc_id", "lang", "source", "text", both.alias("both"))
    ids = F.col("both.ids")
    return out.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("both.decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_ids", bpe_ids),
]

#: No SQL can express language models, mixing or byte-pair merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
