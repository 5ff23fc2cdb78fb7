"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Defined results for odd input, in every stage: rows are told apart by id and
text, so rows that share an id keep their own verdicts and a null id is one like
any other; repeated rows go or stay together, but for the near-duplicate stage,
which leaves one of them; null and empty texts fail the quality rules; very long
texts are read whole; further columns are carried along; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.decontamination import contamination
from tessera.llm.near_dups import near_duplicate_sets
from tessera.llm.packing import pack
from tessera.llm.pii import mask_documents
from tessera.llm.quality_rules import quality_rules

KEY = "__pipeline_key"

#: SQL can't express components, the random field or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, key: Column, rejected: DataFrame) -> DataFrame:
    """The rows whose key isn't among the rejected keys."""
    return docs.withColumn(KEY, key).join(rejected.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows alike in id, text and source share a verdict."""
    key = F.xxhash64("doc_id", "source", "text")
    verdicts = quality_rules(docs.withColumn(KEY, key), id_col=KEY)
    return _without(docs, key, verdicts.where("not kept"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id.

    Texts link where the sets of their shingles of five words have a Jaccard
    similarity of 0.8 or more, counted exactly. Rows that share an id but not a
    text are documents of their own; of rows alike in both one stays.
    """
    found = materialize(near_duplicate_sets(docs, words=5, num=4, den=5), "near-dups")
    # Only keys that go or that several rows share need a decision.
    decided = found.groupBy("doc_id", "same").agg(F.bool_or("first").alias("first"), F.count(F.lit(1)).alias("n")).where("not first or n > 1")
    decided = decided.select(F.col("doc_id").alias(KEY + "_id"), F.col("same").alias(KEY + "_same"), F.col("first").alias(KEY + "_first"))
    keyed = docs.withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit(""))))
    mine = F.col("doc_id").eqNullSafe(F.col(KEY + "_id")) & (F.col(KEY) == F.col(KEY + "_same"))
    alone = keyed.join(decided, mine, "left_anti")
    repeated = keyed.join(decided.where(F.col(KEY + "_first")), mine, "left_semi").dropDuplicates(["doc_id", KEY])
    return alone.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go. Rows alike in id and text share a verdict."""
    key = F.xxhash64("doc_id", "text")
    found = contamination(docs.withColumn(KEY, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    return _without(docs, key, found)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows the new texts."""
    masked = mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
