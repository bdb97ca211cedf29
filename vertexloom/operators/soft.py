"""Soft assignment: log-domain scaling, neighbourhood consistency, greedy extraction, swap refinement."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.operators.assign import PAIRS, assignment, matching
from vertexloom.operators.graph import Graph
from vertexloom.tables import written


def _log_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with out, the log of the key's sum of exp(value), from the largest down: rows move once, and none is joined."""
    own = Window.partitionBy(key)
    rows = rows.withColumn("most", F.max(value).over(own))
    total = F.sum(F.exp(F.col(value) - F.col("most")).cast("decimal(28,18)")).over(own)
    return rows.withColumn(out, F.col("most") + F.log(total.cast("double"))).drop("most")


def sinkhorn(costs: DataFrame, epsilon: float = 0.1, rounds: int = 500, tolerance: float = 1e-3, n: int | None = None) -> tuple[DataFrame, dict]:
    """(source, target, probability) with sources and targets scaled to sum to one, in turn, in the log domain; and diagnostics.

    Each round is written, and one number reaches the driver. Status: converged, round_limit,
    not_square (another number of targets than of sources), invalid_support (with n: a source or
    target without a candidate), numerical_failure (a cost, or a sum, isn't finite). The logits
    themselves are scaled, from their greatest down, so there are no potentials that could drift.
    """
    rows = written(costs.select("source", "target", (-F.col("cost") / epsilon).alias("logit")), "logits")
    none = rows.select("source", "target", F.lit(None).cast("double").alias("probability")).limit(0)
    sizes = rows.agg(F.count_distinct("source").alias("a"), F.count_distinct("target").alias("b"), F.count_if(F.col("logit").isNull() | F.isnan("logit") | (F.abs("logit") == float("inf"))).alias("odd")).first()
    if sizes.odd:
        return none, {"status": "numerical_failure", "rounds": 0}
    if n is not None and (sizes.a != n or sizes.b != n):
        return none, {"status": "invalid_support", "rounds": 0}
    if sizes.a != sizes.b:
        return none, {"status": "not_square", "rounds": 0}
    error, done = float("inf"), 0
    while done < rounds and error > tolerance:
        rows = _log_sum(rows, "source", "logit", "f").select("source", "target", (F.col("logit") - F.col("f")).alias("logit"))
        rows = written(_log_sum(rows, "target", "logit", "g").select("source", "target", (F.col("logit") - F.col("g")).alias("logit")), "scaled")
        done += 1
        sums = rows.groupBy("source").agg(F.sum(F.exp("logit")).alias("s"))
        error = sums.agg(F.max(F.abs(F.col("s") - 1))).first()[0] or 0.0
        if not math.isfinite(error):
            return none, {"status": "numerical_failure", "rounds": done}
    return rows.select("source", "target", F.exp("logit").alias("probability")), {"status": "converged" if error <= tolerance else "round_limit", "rounds": done, "error": error}


#: Arcs of a block of sources whose neighbourhoods one task looks through at a time, and the greatest value that sums take (in whole numbers of 1e-12).
BLOCK_ARCS, MOST_VALUE = 50_000, 1000


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def _block_consistency(near: pa.Table, mine: pa.Table) -> pa.Table:
    """Of the block's candidates (source, target, neighbours of the target) the sums of the values (targets, values) next to their sources."""
    source, target = mine.column("source").to_numpy(), mine.column("target").to_numpy()
    total = np.zeros(len(source), np.int64)
    if len(source) and near.num_rows:
        t, row = _flat(near.column("targets"))
        value, own = _flat(near.column("values"))[0], near.column("source").to_numpy()[row]
        other, at = _flat(mine.column("others"))
        _, i = np.unique(np.concatenate([own, source]), return_inverse=True)
        ids, j = np.unique(np.concatenate([t, other]), return_inverse=True)
        key = i[: len(own)] * len(ids) + j[: len(t)]
        order = np.argsort(key, kind="stable")
        key, start = np.unique(key[order], return_index=True)
        sums = np.add.reduceat(value[order], start)
        asked = i[len(own) :][at] * len(ids) + j[len(t) :]
        place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        np.add.at(total, at, np.where(key[place] == asked, sums[place], 0))
    return pa.table({"source": source, "target": target, "consistency": total / 1e12})


def consistency(support: DataFrame, one: Graph, two: Graph, value: str = "probability") -> DataFrame:
    """source, target, consistency: for each candidate, the value of candidates between neighbours of both.

    Blocks of sources get the candidates of their neighbours, as one list an arc, and the
    neighbours of their own targets, as one list a candidate, and look these up in those: no pair of
    neighbours is ever a row.
    """
    a = one.adjacency.select(F.col("v").alias("source"), F.col("u").alias("near"))
    b = two.adjacency.groupBy(F.col("u").alias("target")).agg(F.collect_list("v").alias("others"))
    held = support.select(F.col("source").alias("near"), "target", _whole(value).alias("value")).where("value is not null")
    held = held.groupBy("near").agg(F.collect_list(F.struct("target", "value")).alias("h"))
    blocks = max(1, -(-2 * one.edges.count() // BLOCK_ARCS))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block")
    near = a.join(held, "near").select(block, "source", F.col("h.target").alias("targets"), F.col("h.value").alias("values"))
    mine = support.select("source", "target").join(b, "target", "left").select(block, "source", "target", F.coalesce("others", F.array().cast("array<long>")).alias("others"))
    return near.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_block_consistency, "source long, target long, consistency double")


def _block_links(near: pa.Table, mine: pa.Table) -> pa.Table:
    """Of the block's candidates (source, target, neighbours of the target) those (targets) of their sources' neighbours (near) that lie next to their targets."""
    source, target = mine.column("source").to_numpy(), mine.column("target").to_numpy()
    t, row = _flat(near.column("targets"))
    other, at = _flat(mine.column("others"))
    own, by_near = near.column("source").to_numpy()[row], near.column("near").to_numpy()[row]
    _, i = np.unique(np.concatenate([own, source]), return_inverse=True)
    ids, j = np.unique(np.concatenate([t, other]), return_inverse=True)
    key = i[: len(own)] * len(ids) + j[: len(t)]
    order = np.argsort(key, kind="stable")
    key, asked = key[order], i[len(own) :][at] * len(ids) + j[len(t) :]
    start = np.searchsorted(key, asked)
    hit = np.flatnonzero(key[np.minimum(start, len(key) - 1)] == asked) if len(key) else np.zeros(0, np.int64)
    start = start[hit]
    size = np.searchsorted(key, asked[hit], "right") - start
    place = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)]
    pair = np.repeat(at[hit], size)
    return pa.table({"source": source[pair], "target": target[pair], "near": by_near[place], "other": t[place]})


def links(support: DataFrame, one: Graph, two: Graph) -> DataFrame:
    """source, target, near, other: candidates, and the candidates between neighbours of both, as consistency() sums them.

    These don't change with the values. There are at most k * k of an arc.
    """
    pairs = support.select("source", "target").distinct()
    a = one.adjacency.select(F.col("v").alias("source"), F.col("u").alias("near"))
    b = two.adjacency.groupBy(F.col("u").alias("target")).agg(F.collect_list("v").alias("others"))
    held = pairs.groupBy(F.col("source").alias("near")).agg(F.collect_list("target").alias("targets"))
    blocks = max(1, -(-2 * one.edges.count() // BLOCK_ARCS))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block")
    near = a.join(held, "near").select(block, "source", "near", "targets")
    mine = pairs.join(b, "target").select(block, "source", "target", "others")
    return near.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_block_links, "source long, target long, near long, other long")


def _whole(value: str):
    """A value in whole numbers of 1e-12."""
    large = F.when(F.abs(value) >= MOST_VALUE, F.raise_error(F.lit("a value is too large to sum")).cast("double")).otherwise(F.col(value))
    return (large.cast("decimal(18,12)") * F.lit(10**12).cast("decimal(13,0)")).cast("long")


def linked_consistency(shares: DataFrame, linked: DataFrame) -> DataFrame:
    """consistency() of probabilities over links(), without the candidates that have none."""
    values = shares.select(F.col("source").alias("near"), F.col("target").alias("other"), _whole("probability").alias("value"))
    sums = linked.join(values.hint("shuffle_hash"), ["near", "other"]).groupBy("source", "target").agg(F.sum("value").alias("value"))
    return sums.where("value is not null").select("source", "target", (F.col("value") / 1e12).alias("consistency"))


def mixed(scores: DataFrame, extra: DataFrame, alpha: float = 0.4, beta: float = 0.6, scaled: bool = False) -> DataFrame:
    """source, target, similarity: alpha times the score and beta times the consistency, over its maximum if scaled."""
    if scaled:
        most = extra.agg(F.greatest(F.max("consistency"), F.lit(1e-12)).alias("most"))
        extra = extra.crossJoin(F.broadcast(most)).select("source", "target", (F.col("consistency") / F.col("most")).alias("consistency"))
    return scores.join(extra, ["source", "target"], "left").select("source", "target", (alpha * F.col("similarity") + beta * F.coalesce("consistency", F.lit(0.0))).alias("similarity"))


#: So few pairs are taken in sequence, by one task; more are taken in rounds until so few are left.
SEQUENCE = 1 << 23


def _in_sequence(batches):
    """Of pairs in order those that are free on both sides."""
    sources, targets = set(), set()
    for pdf in batches:
        keep = []
        for s, t in zip(pdf["source"].tolist(), pdf["target"].tolist()):
            free = s not in sources and t not in targets
            if free:
                sources.add(s)
                targets.add(t)
            keep.append(free)
        yield pdf[keep]


def greedy(scores: DataFrame, value: str = "similarity") -> DataFrame:
    """source, target, value: each pair taken if both are free, by (value descending, source, target).

    Rounds: a pair that comes first for both its source and its target is taken in any order of the
    rest, so all such are taken at once, and what touches them goes. Equal to the sequence, and each
    round is written. Ties make long chains of rounds, so the last SEQUENCE pairs are taken in sequence.
    """
    left = written(scores.select("source", "target", F.col(value).alias("value")), "greedy")
    order = [F.col("value").desc(), "source", "target"]
    taken = None
    while True:
        if left.count() <= SEQUENCE:
            now = written(left.repartition(1).sortWithinPartitions(*order).mapInPandas(_in_sequence, left.schema), "taken")  # bounded by SEQUENCE
            return now if taken is None else taken.unionByName(now)
        ranks = left.withColumn("a", F.row_number().over(Window.partitionBy("source").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
        now = written(ranks.where("a = 1 and b = 1").select("source", "target", "value"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        left = written(left.join(now.select("source"), "source", "left_anti").join(now.select("target"), "target", "left_anti"), "left")


def reduced_assignment(scores: DataFrame, pairs: DataFrame, tau: float, ambiguous: str = "low", exact: bool = True) -> DataFrame:
    """source, target: the greedy pairs that are sure, and an assignment of the ambiguous sources to targets that are still free.

    ambiguous: "low", sources that are unmatched or matched below tau; "unmatched", only those without
    a pair. exact: a least-cost assignment, by components at any size, of as many of them as a maximum
    matching has; else greedy pairs again.
    """
    if ambiguous not in ("low", "unmatched"):
        raise ValueError(f"unknown choice of ambiguous sources: {ambiguous}")
    sure = written((pairs.where(F.col("value") >= tau) if ambiguous == "low" else pairs).select("source", "target"), "sure")
    rest = written(scores.join(sure.select("source"), "source", "left_anti").join(sure.select("target"), "target", "left_anti").select("source", "target", "similarity"), "rest")
    if not exact:
        return sure.unionByName(greedy(rest).select("source", "target"))
    ends = rest.agg(F.max("source"), F.max("target")).first()
    if ends[0] is None:
        return sure
    n, m = ends[0] + 1, ends[1] + 1
    # Sources in conflict have fewer targets than they are, and a maximum matching has all of these
    # targets with some of them, and all other sources with other targets. So the targets choose
    # there, and the sources elsewhere: both have an assignment of all, and no source need be left over.
    conflict = written(matching(rest, n, m).where("conflict").select("source"), "conflict")
    tight = rest.join(conflict, "source", "left_semi")
    loose = rest.join(conflict, "source", "left_anti").join(tight.select("target").distinct(), "target", "left_anti")
    cost = (-F.col("similarity")).alias("cost")
    rows = loose.select("source", "target", cost).unionByName(tight.select((F.col("target") + n).alias("source"), (F.col("source") + m).alias("target"), cost))
    found = assignment(written(rows, "rest-costs"), n + m, m + n).where("target is not null")
    own = F.col("source") < n
    return sure.unionByName(found.select(F.when(own, F.col("source")).otherwise(F.col("target") - m).alias("source"), F.when(own, F.col("target")).otherwise(F.col("source") - n).alias("target")))


def soft_match(one: Graph, two: Graph, candidates: DataFrame, rounds: int = 3, scaling: int = 5, tau: float = 0.5, epsilon: float = 0.1) -> DataFrame:
    """source, target: candidates' scores scaled, mixed with neighbourhood consistency, again and again; then greedy pairs and the reduced assignment."""
    scores = candidates.select("source", "target", "similarity")
    linked = written(links(scores, one, two), "linked") if rounds else None
    for _ in range(rounds):
        shares, _ = scaled_rounds(scores, scaling, epsilon)
        scores = written(mixed(scores, written(linked_consistency(shares, linked), "consistency"), scaled=True), "mixed")
    return reduced_assignment(scores, greedy(scores), tau)


def _key_log_sums(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The logs of the keys' sums of exp(value), of values by key; sums don't depend on the order."""
    most = np.maximum.reduceat(value, start)
    share = np.exp(value - np.repeat(most, np.diff(np.r_[start, len(value)]))) * 1e9
    large = np.floor(share)
    low = np.add.reduceat(np.rint((share - large) * 1e9).astype(np.int64), start)
    high = np.add.reduceat(large.astype(np.int64), start) + low // 10**9
    return most + np.log(high / 1e9 + (low % 10**9) / 1e18)


def _scaled_table(table: pa.Table, rounds: int, first: str, last: str) -> pa.Table:
    """source, target, probability of all pairs (source, target, logit), scaled by first and last in turn."""
    value, sides = table.column("logit").to_numpy().copy(), []
    for name in (first, last):
        key = table.column(name).to_numpy()
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        sides.append((order, start, np.diff(np.r_[start, len(key)])))
    for _ in range(rounds):
        for order, start, size in sides:
            mine = value[order]
            value[order] = mine - np.repeat(_key_log_sums(mine, start), size)
    return pa.table({"source": table.column("source"), "target": table.column("target"), "probability": np.exp(value)})


def scaled_rounds(scores: DataFrame, rounds: int, epsilon: float = 0.1, last: str = "target") -> tuple[DataFrame, int]:
    """source, target, probability after a fixed number of scalings by source and target, in the order that ends with last; any shape.

    Up to PAIRS pairs, all finite, are scaled by one task; others in rounds that are written.
    """
    if last not in ("source", "target"):
        raise ValueError(f"scaling ends with source or target, not {last}")
    rows, first = scores.select("source", "target", (F.col("similarity") / epsilon).alias("logit")), "source" if last == "target" else "target"
    sizes = rows.agg(F.count("*").alias("n"), F.count_if((F.abs("logit") < float("inf")) & F.col("source").isNotNull() & F.col("target").isNotNull()).alias("finite")).first()
    if sizes.n == sizes.finite <= PAIRS:

        def scaled(batches):
            pairs = [x for x in batches if x.num_rows]
            if pairs:
                yield from _scaled_table(pa.Table.from_batches(pairs), rounds, first, last).to_batches(max_chunksize=1 << 20)

        long = rows.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "logit")
        return written(long.repartition(1).mapInArrow(scaled, "source long, target long, probability double"), "scaled"), rounds  # bounded by PAIRS
    for _ in range(rounds):
        rows = _log_sum(rows, first, "logit", "f").select("source", "target", (F.col("logit") - F.col("f")).alias("logit"))
        rows = written(_log_sum(rows, last, "logit", "g").select("source", "target", (F.col("logit") - F.col("g")).alias("logit")), "scaled")
    return rows.select("source", "target", F.exp("logit").alias("probability")), rounds


def swap_refined(edges_a: list[tuple[int, int]], edges_b: list[tuple[int, int]], mapping: dict[int, int], support: dict[int, set[int]], attempts: int, seed: int = 0, seconds: float | None = None) -> tuple[dict[int, int], int]:
    """The mapping after swaps of two sources' targets within the support that raise the number of edges kept; and that gain.

    Sequential by nature: in the driver, for graphs that fit there.
    """
    near: dict[int, set[int]] = {}
    for u, v in edges_a:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    held = {(min(e), max(e)) for e in edges_b}
    mapping, order, r = dict(mapping), sorted(mapping), random.Random(seed)
    until, gain = time.monotonic() + seconds if seconds else float("inf"), 0

    def kept(i: int, j: int) -> int:
        pairs = {(min(x, y), max(x, y)) for x in (i, j) for y in near.get(x, ())}
        return sum((min(mapping[x], mapping[y]), max(mapping[x], mapping[y])) in held for x, y in pairs if x in mapping and y in mapping)

    for _ in range(attempts if len(order) > 1 else 0):
        if time.monotonic() > until:
            break
        i, j = r.sample(order, 2)
        if mapping[j] not in support.get(i, ()) or mapping[i] not in support.get(j, ()):
            continue
        before = kept(i, j)
        mapping[i], mapping[j] = mapping[j], mapping[i]
        if (after := kept(i, j)) > before:
            gain += after - before
        else:
            mapping[i], mapping[j] = mapping[j], mapping[i]
    return mapping, gain
