"""The operators as queries over the tables in a folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chaining, exact_dedup, htmltext, langid, lmscore, mixing, mpegaudio, packing, pii, simhash


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"))


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return mpegaudio.features(mpegaudio.media(_table(spark, folder, "documents")))


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).drop("source")


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.repeated_passages(_table(spark, folder, "documents"))


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(_table(spark, folder, "pages"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_lm_score, op3_language_id, op4_media_columns, op5_source_mix, op6_repeated_passages, op7_html_text, op8_pii, op9_packing, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op5_source_mix": mixing.SQL}
