"""From raw documents to sharded training text.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last adds
shard_id and shard_slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import scratch, table
from granary.llm.decontaminate import clean_of
from granary.llm.mixing import training_order
from granary.llm.near_dedup import keep_one
from granary.llm.quality import keep_good
from granary.llm.sharding import sharded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is in the range of trusted ones of their language."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents to the sources' target weights, in the order of training."""
    return training_order(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy with its shard and its place there."""
    return sharded(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Perplexity, edit distances and classes can't be expressed in SQL; tests hold the stages against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``; each one's rows are written, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
