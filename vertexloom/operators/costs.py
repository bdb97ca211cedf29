"""Sparse costs as a table (source, target, cost): a pair that isn't there is forbidden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.scores import cost


def costs(candidates: DataFrame) -> DataFrame:
    return candidates.select("source", "target", cost(F.col("similarity")).alias("cost"))


def checks(table: DataFrame, k: int, n_sources: int, n_targets: int) -> DataFrame:
    """One row of counts of what a cost table must not have."""
    pairs = table.groupBy("source", "target").agg(F.count("*").alias("n"), F.count_if(F.col("cost").isNull() | F.isnan("cost") | (F.abs("cost") == float("inf"))).alias("odd"))
    rows = pairs.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("odd").alias("odd"), F.count_if((F.col("target") < 0) | (F.col("target") >= n_targets)).alias("out"))
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count_if(F.col("n") > k).alias("long_rows"),
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("not_finite"),
        (F.coalesce(F.sum("out"), F.lit(0)) + F.count_if((F.col("source") < 0) | (F.col("source") >= n_sources))).alias("out_of_range"),
        (4 * (F.lit(n_sources).cast("long") + 1) + 8 * F.coalesce(F.sum("n"), F.lit(0))).alias("csr_bytes"),
    )


def by_target(table: DataFrame) -> DataFrame:
    """target, sources, least cost: the reverse index."""
    return table.groupBy("target").agg(F.count("*").alias("sources"), F.min("cost").alias("least_cost"))


def lookup(table: DataFrame, pairs: DataFrame, missing: float = 1e30) -> DataFrame:
    return pairs.join(table, ["source", "target"], "left").select("source", "target", F.coalesce("cost", F.lit(missing)).alias("cost"))


def negated(candidates: DataFrame) -> DataFrame:
    """source, target, cost: the score with its sign turned, as baselines take it."""
    return candidates.select("source", "target", (-F.col("similarity")).alias("cost"))
