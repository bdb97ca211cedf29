"""A corpus pipeline over the documents table: language ID, exact dedup, near-dedup, mixing, packing.

Every stage decides row by row, so that doc_ids may be null or stand on several rows, and columns may
be called anything; all but the last return the columns of documents. Null texts count as empty. An
empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import common, exact_dedup, langid, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null and empty texts, texts without letters and those of few known n-grams go. Repeated rows are decided alike."""
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of most code points, then of smallest doc_id (null last), then one of the rows."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id (null last), of rows that share it one."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, null source included; rows that are alike are taken as often as their places say. Documents without words have no size and stay out or come in as their places say."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; an empty text is one piece of the closing id."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near-dedup", near), ("source mix", mix), ("packing", pack)]

#: SQL can't express the stages (fingerprints by XXH64, tokenizer ids, a fitted model).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{common.shared_dir(spark)}/vertexloom/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{at}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
