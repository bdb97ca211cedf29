"""What a candidate support allows: coverage, matching, conflicts, repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.operators.assign import matching
from vertexloom.operators.evaluate import recall
from vertexloom.tables import written


def incoming(support: DataFrame, targets: DataFrame) -> DataFrame:
    """target, incoming for all targets (v), zeros included."""
    counts = support.groupBy("target").agg(F.count("*").alias("incoming"))
    return targets.select(F.col("v").alias("target")).join(counts, "target", "left").select("target", F.coalesce("incoming", F.lit(0)).alias("incoming"))


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("incoming").agg(F.count("*").alias("targets"))


def report(support: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: edges, sources without candidates, targets without sources, least and most candidates of a source."""
    rows = sources.select(F.col("v").alias("source")).join(support.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    one = rows.agg(F.sum("n").alias("edges"), F.count_if(F.col("n") == 0).alias("empty_sources"), F.min("n").alias("row_min"), F.max("n").alias("row_max"))
    two = incoming(support, targets).agg(F.count_if(F.col("incoming") == 0).alias("uncovered_targets"))
    return one.crossJoin(F.broadcast(two))


def defects(support: DataFrame, n_targets: int) -> DataFrame:
    """One row of counts: repeated targets, targets out of range, scores that aren't finite, ranks that don't follow."""
    pairs = support.groupBy("source", "target").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    rows = support.groupBy("source").agg((F.max("rank") - F.count("*") + 1).alias("holes"), F.min("rank").alias("first"))
    ranks = rows.agg(F.count_if((F.col("holes") != 0) | (F.col("first") != 0)).alias("bad_ranks"))
    rest = support.agg(F.count_if((F.col("target") < 0) | (F.col("target") >= n_targets)).alias("out_of_range"), F.count_if(F.col("similarity").isNull() | F.isnan("similarity")).alias("not_finite"))
    return pairs.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(ranks))  # one row each


def matched_report(support: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """report() with the size of a maximum matching, and feasible: whether it has all sources. Vertices are dense from 0."""
    n, m = sources.count(), targets.count()
    size = matching(support, n, m).agg(F.count("target").alias("matching"))
    return report(support, sources, targets).crossJoin(F.broadcast(size)).withColumn("feasible", F.col("matching") == n)  # one row each


def diagnostics(support: DataFrame, truth: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: recall, coverage and matching of a support together."""
    return recall(support, truth).crossJoin(F.broadcast(matched_report(support, sources, targets)))  # one row each


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: pairs of either support, those that only the later one has, and those that it lost: what a rerun at another k did."""
    key = ["source", "target"]
    both = before.select(*key, F.lit(1).alias("x")).join(after.select(*key, F.lit(1).alias("y")), key, "full")
    return both.agg(F.count("x").alias("edges_before"), F.count("y").alias("edges_after"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"))


#: Bytes of a stored candidate: a target and a score.
CANDIDATE_BYTES = 8


def _stopped(more: DataFrame, conflict: DataFrame, edges: int, k: int, max_edges: int | None, max_bytes: int | None) -> str | None:
    """The limit that a round breaks first, source after source in order: payload (room for k is asked for before a source's candidates are made) or candidates."""
    if max_edges is None and max_bytes is None:
        return None
    counts = conflict.join(more.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))
    until = F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))  # a number a source in conflict
    over = counts.withColumn("until", until)
    full = F.lit(False) if max_bytes is None else edges + F.col("until") - F.col("n") + k > max_bytes // CANDIDATE_BYTES
    many = F.lit(False) if max_edges is None else edges + F.col("until") > max_edges
    first = over.where(full | many).orderBy("source").select(full.alias("full")).first()
    return None if first is None else "payload_limit" if first.full else "candidate_limit"


def repair(
    support: DataFrame, n_sources: int, n_targets: int, k: int, prefix: Callable[[DataFrame, int], DataFrame], k_limit: int | None = None, max_rounds: int = 20, max_edges: int | None = None, max_bytes: int | None = None
) -> tuple[DataFrame, str, list[dict]]:
    """The support grown until all sources can be matched: (support, why it stopped, history).

    Each round doubles k, up to k_limit, for the sources in conflict only: prefix(sources, k) gives
    their k best (source, rank, target, similarity); new targets are appended, none is replaced.
    Stops, in this order: feasible, prefix_limit, round_limit, payload_limit, candidate_limit; a round that breaks a limit adds nothing.
    """
    if not 0 < k <= (k_limit or n_targets) or max_rounds < 0:
        raise ValueError("k must be positive and at most k_limit, max_rounds not negative")
    k_limit, history = min(k_limit or n_targets, n_targets), []
    while True:
        found = written(matching(support, n_sources, n_targets), "matching")
        size, edges = found.where("target is not null").count(), support.count()
        history.append({"k": k, "matching": size, "edges": edges})
        if size == n_sources:
            return support, "feasible", history
        if k >= k_limit:
            return support, "prefix_limit", history
        if len(history) > max_rounds:
            return support, "round_limit", history
        k = min(2 * k, k_limit)
        conflict = found.where("conflict").select("source")
        more = written(prefix(conflict, k).join(support.select("source", "target"), ["source", "target"], "left_anti"), "more")
        if stop := _stopped(more, conflict, edges, k, max_edges, max_bytes):
            return support, stop, history
        last = support.groupBy("source").agg((F.max("rank") + 1).alias("base"))
        placed = more.join(last, "source", "left").withColumn("rank", (F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("source").orderBy("rank")) - 1).cast("int"))
        support = written(support.select("source", "rank", "target", "similarity").unionByName(placed.select("source", "rank", "target", "similarity")), "support")
