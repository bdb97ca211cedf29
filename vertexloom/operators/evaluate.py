"""Measures of a mapping (source, target) against truth, support and graphs, each apart from the others."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.scores import draw
from vertexloom.operators.graph import Graph, mapped_edges

#: Pairs up to which a signed-rank test without ties is exact.
EXACT_PAIRS = 50


def _share(part: Column, whole: Column) -> Column:
    """part / whole; 1 of nothing."""
    return F.when(whole == 0, 1.0).otherwise(part / F.when(whole == 0, 1).otherwise(whole))


def one_to_one(mapping: DataFrame, n_targets: int) -> DataFrame:
    bad = F.count_if(F.col("target").isNull() | (F.col("target") < 0) | (F.col("target") >= n_targets))
    return mapping.agg(((bad == 0) & (F.count("*") == F.count_distinct("target")) & (F.count("*") == F.count_distinct("source"))).alias("one_to_one"))


def accuracy(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: vertices, matched, right, accuracy over all of truth, accuracy over the matched."""
    rows = truth.select("source", F.col("target").alias("wanted")).join(mapping, "source", "left")
    right = F.count_if(F.col("target") == F.col("wanted"))
    return rows.agg(F.count("*").alias("vertices"), F.count("target").alias("matched"), right.alias("right"), F.round(_share(right, F.count("*")), 6).alias("accuracy"), F.round(_share(right, F.count("target")), 6).alias("accuracy_matched"))


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many true pairs are candidates."""
    found = truth.join(candidates.select("source", "target", F.lit(1).alias("has")), ["source", "target"], "left")
    return found.agg(F.count("*").alias("vertices"), F.count("has").alias("found"), F.round(_share(F.count("has"), F.count("*")), 6).alias("recall"))


def inverse(mapping: DataFrame) -> DataFrame:
    """target as source, source as target; of sources with one target the last (greatest) stays. Unmatched sources have none."""
    turned = mapping.where("target is not null").groupBy("target").agg(F.max("source").alias("source"))
    return turned.select(F.col("target").alias("source"), F.col("source").alias("target"))


def permutation(mapping: DataFrame, n: int) -> DataFrame:
    """One row: whether mapping is a permutation of 0 to n - 1."""
    inside = F.count_if(F.col("source").between(0, n - 1) & F.col("target").between(0, n - 1))
    return mapping.agg(((inside == n) & (F.count("*") == n) & (F.count_distinct("source") == n) & (F.count_distinct("target") == n)).alias("permutation"))


def truth_checks(truth: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    """One row of counts of what a truth must not have: sources without a target, ids out of range, sources and targets that stand twice."""
    sources = truth.groupBy("source").agg(F.count("*").alias("n"), F.count("target").alias("m"))
    one = sources.agg(
        (F.lit(n_sources).cast("long") - F.count_if(F.col("source").between(0, n_sources - 1) & (F.col("m") > 0))).alias("uncovered"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_sources")
    )
    two = truth.where("target is not null").groupBy("target").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_targets"))
    three = truth.agg(F.count_if(~F.col("source").between(0, n_sources - 1) | ~F.col("target").between(0, n_targets - 1)).alias("out_of_range"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # one row each


def preservation(one: Graph, two: Graph, mapping: DataFrame) -> DataFrame:
    """One row: edges of either graph, those that mapping takes onto edges, shares in both directions, and the squared distance of the adjacency matrices.

    forward counts edges of the first graph, backward the edges of the second one whose inverse
    image is an edge, so that edges laid on each other count once there. The distance is null unless
    the mapping is a permutation between vertex sets of one size.
    """
    ok = mapping.where("target is not null")
    kept = mapped_edges(one.edges, ok).join(two.edges, ["u", "v"], "left_semi").agg(F.count("*").alias("kept"))
    back = mapped_edges(two.edges, inverse(ok)).join(one.edges, ["u", "v"], "left_semi").agg(F.count("*").alias("kept_back"))
    a, b = one.edges.agg(F.count("*").alias("edges_a")), two.edges.agg(F.count("*").alias("edges_b"))
    n, m = one.vertices.agg(F.count("*").alias("n")), two.vertices.agg(F.count("*").alias("m"))
    whole = ok.agg(F.count("*").alias("pairs"), F.count_distinct("source").alias("ss"), F.count_distinct("target").alias("ts"))
    row = kept
    for other in (back, a, b, n, m, whole):
        row = row.crossJoin(F.broadcast(other))  # one row each
    bijective = (F.col("n") == F.col("m")) & (F.col("pairs") == F.col("n")) & (F.col("ss") == F.col("n")) & (F.col("ts") == F.col("n"))
    return row.select(
        "edges_a", "edges_b", "kept", "kept_back", F.round(_share(F.col("kept"), F.col("edges_a")), 6).alias("forward"), F.round(_share(F.col("kept_back"), F.col("edges_b")), 6).alias("backward"),
        F.when(bijective, 2 * (F.col("edges_a") + F.col("edges_b") - 2 * F.col("kept"))).alias("qap_cost"),
    )


def mapping_report(mapping: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accuracy and cost are null unless every vertex is matched; how many pairs are on the support."""
    rows = truth.select("source", F.col("target").alias("wanted")).join(mapping.select("source", "target"), "source", "left").join(candidates.select("source", "target", "similarity"), ["source", "target"], "left")
    n, m = F.count("*"), F.count("target")
    return rows.agg(
        n.alias("vertices"), m.alias("matched"), F.count("similarity").alias("on_support"),
        F.when(n == m, F.round(F.count_if(F.col("target") == F.col("wanted")) / F.when(n == 0, 1).otherwise(n), 6)).alias("accuracy"),
        F.when(n == F.count("similarity"), F.round(F.sum((1 - F.col("similarity")).cast("decimal(28,9)")).cast("double"), 6)).alias("cost"),
    )


def compare_rankings(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: pairs of either, pairs in both, pairs of equal rank, the largest difference of scores, sources with the same set."""
    both = one.select("source", "target", F.col("rank").alias("r1"), F.col("similarity").alias("s1")).join(two.select("source", "target", F.col("rank").alias("r2"), F.col("similarity").alias("s2")), ["source", "target"], "full")
    rows = both.groupBy("source").agg(F.count("r1").alias("n1"), F.count("r2").alias("n2"), F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("common"), F.count_if(F.col("r1") == F.col("r2")).alias("same_rank"), F.max(F.abs(F.col("s1") - F.col("s2"))).alias("apart"))
    return rows.agg(F.sum("n1").alias("pairs_one"), F.sum("n2").alias("pairs_two"), F.sum("common").alias("common"), F.sum("same_rank").alias("same_rank"), F.round(F.coalesce(F.max("apart"), F.lit(0.0)), 9).alias("most_apart"), F.count_if((F.col("n1") == F.col("common")) & (F.col("n2") == F.col("common"))).alias("same_sets"))


def compare_support(exact: DataFrame, other: DataFrame, truth: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """One row: how much of the exact Top-K another support has, entries below the exact cutoff, true pairs lost and gained."""
    cut = exact.groupBy("source").agg(F.min("similarity").alias("cut"))
    rows = other.select("source", "target", "similarity").join(cut, "source", "left").join(exact.select("source", "target", F.lit(1).alias("in_exact")), ["source", "target"], "left")
    one = rows.agg(F.count("*").alias("pairs"), F.count("in_exact").alias("overlap"), F.count_if(F.col("similarity") < F.col("cut") - tolerance).alias("below_cutoff"))
    hits = truth.join(exact.select("source", "target", F.lit(1).alias("e")), ["source", "target"], "left").join(other.select("source", "target", F.lit(1).alias("o")), ["source", "target"], "left")
    two = hits.agg(F.count_if(F.col("e").isNotNull() & F.col("o").isNull()).alias("truth_lost"), F.count_if(F.col("e").isNull() & F.col("o").isNotNull()).alias("truth_gained"))
    return one.crossJoin(F.broadcast(two))


def missing_from(exact: DataFrame, other: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """source, target, similarity, strictly: pairs of the exact Top-K that another support lacks; strictly: better than all that it has for the source."""
    best = other.groupBy("source").agg(F.max("similarity").alias("best"))
    rows = exact.select("source", "target", "similarity").join(other.select("source", "target"), ["source", "target"], "left_anti").join(best, "source", "left")
    return rows.select("source", "target", "similarity", F.coalesce(F.col("similarity") > F.col("best") + tolerance, F.lit(True)).alias("strictly"))


def audit(candidates: DataFrame, following: DataFrame, truth_scores: DataFrame, k: int) -> DataFrame:
    """One row: sources whose k-th and next score tie, true pairs that the candidates lack, how far below the k-th score they are, and the greatest error of a stored score.

    following: the Top-(k + 1); truth_scores: source, target, similarity of the true pairs, scored apart.
    """
    cut = candidates.where(F.col("rank") == k - 1).select("source", F.col("similarity").alias("cut"))
    rows = truth_scores.join(candidates.select("source", "target", F.col("similarity").alias("stored")), ["source", "target"], "left").join(cut, "source", "left")
    gap = F.when(F.col("stored").isNull(), F.col("cut") - F.col("similarity"))
    found = rows.agg(
        F.count_if(F.col("stored").isNull()).alias("omitted"), F.round(F.min(gap), 6).alias("least_gap"), F.round(F.max(gap), 6).alias("most_gap"), F.count_if(F.abs(gap) < 5e-10).alias("omitted_by_tie"),
        F.round(F.max(F.abs(F.col("stored") - F.col("similarity"))), 9).alias("score_error"),
    )
    return boundary_ties(candidates, following, k).crossJoin(F.broadcast(found))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows, and a digest of them that doesn't depend on their order."""
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(draw(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(0)).alias("digest"))


def evaluation(one: Graph, two: Graph, mapping: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of everything: the mapping against truth and graphs, recall of the candidates, digests of the inputs. Optimal descriptors don't prove a right correspondence."""
    parts = [accuracy(mapping, truth), preservation(one, two, mapping), recall(candidates, truth).select(F.col("recall").alias("candidate_recall")), candidates.agg(F.count("*").alias("candidates"))]
    parts += [fingerprint(rows, *names).select(F.col("digest").alias(f"digest_{what}")) for what, rows, names in (("source", one.edges, "uv"), ("target", two.edges, "uv"), ("mapping", mapping, ("source", "target")), ("truth", truth, ("source", "target")))]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def boundary_ties(candidates: DataFrame, scored_k_plus_one: DataFrame, k: int) -> DataFrame:
    """One row: sources, and those whose k-th and next score are equal."""
    last = candidates.where(F.col("rank") == k - 1).select("source", F.round("similarity", 9).alias("a"))
    following = scored_k_plus_one.where(F.col("rank") == k).select("source", F.round("similarity", 9).alias("b"))
    return last.join(following, "source", "left").agg(F.count("*").alias("sources"), F.count_if(F.col("a") == F.col("b")).alias("tied"))


def summary(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, trials, mean, deviation, least, most, median, p95, p99."""
    exact = lambda p: F.round(F.percentile(value, p), 6)
    mean = F.sum(F.col(value).cast("decimal(28,9)")).cast("double") / F.count(value)
    return values.groupBy(key).agg(F.count(value).alias("trials"), F.round(mean, 6).alias("mean"), F.round(F.stddev_samp(value), 4).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"), exact(0.5).alias("median"), exact(0.95).alias("p95"), exact(0.99).alias("p99"))


def ratios(values: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """key, mean, ratio to the base key's mean, speedup (its inverse); null where the divisor is zero or the base is missing."""
    means = values.groupBy(key).agg((F.sum(F.col(value).cast("decimal(28,9)")).cast("double") / F.count(value)).alias("mean"))
    of = means.where(F.col(key) == base).agg(F.first("mean").alias("base"))
    over = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    return means.crossJoin(F.broadcast(of)).select(key, F.round("mean", 6).alias("mean"), over("mean", "base").alias("ratio"), over("base", "mean").alias("speedup"))  # one row


def exact_p(statistic: float, n: int) -> float:
    """Two-sided chance of a rank sum this small or smaller, over all signs of the ranks 1 to n."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)


def _p_value(statistic: pd.Series, n: pd.Series, exact: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([None if not k or y is None or math.isnan(y) else exact_p(w, int(k)) if e else math.erfc(abs(y) / math.sqrt(2)) for w, k, e, y in zip(statistic, n, exact, z)], dtype="float64")


def signed_rank(trials: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """Wilcoxon's signed-rank test of two measures of the same trials: key, pairs, zeros, w_plus, w_minus, statistic, z, p, mark.

    Trials with a null or not a number on either side don't count, and those without a difference
    only as zeros. Ties share the mean of their ranks. p is exact for up to EXACT_PAIRS pairs
    without ties and zeros, else by the normal distribution with the correction for ties; it and z
    are null where no pair differs. Trials are counted per difference first, so that ranks come
    from a running sum over distinct differences.
    """
    by = F.round(F.col(one).cast("double") - F.col(two).cast("double"), 9)
    rows = trials.select(F.col(key), by.alias("d")).where("d is not null and not isnan(d)")
    sizes = rows.groupBy(key, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    before = F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("n"))).over(Window.partitionBy(key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    used, n = F.col("size") > 0, F.col("n").cast("double")
    sums = ranked.groupBy(key).agg(
        F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(~used, F.col("n"))), F.lit(0)).alias("zeros"),
        F.coalesce(F.sum(F.when(used, F.col("rank") * F.col("plus"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(used, F.col("rank") * (F.col("n") - F.col("plus")))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.when(used, n * n * n - n)), F.lit(0.0)).alias("ties"),
    )
    k = F.col("pairs").cast("double")
    spread = F.sqrt((k * (k + 1) * (2 * k + 1) - F.col("ties") / 2) / 24)
    z = (F.col("w_plus") - k * (k + 1) / 4) / F.nullif(spread, F.lit(0.0))
    exact = (F.col("pairs") <= EXACT_PAIRS) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    out = sums.select(key, "pairs", "zeros", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), F.round(z, 6).alias("z"), z.alias("_z"), exact.alias("_exact"))
    out = out.withColumn("p", F.pandas_udf(_p_value, "double")("statistic", "pairs", "_exact", "_z"))
    mark = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").when(F.col("p").isNotNull(), "ns")
    return out.withColumn("mark", mark).drop("_z", "_exact")
