"""Components, maximum matching, and exact assignment on a sparse support with a dual certificate.

A component of the support is solved in one task, as no relational operator can; components are
independent, and a component's size is the support's, not the corpus'. Supports of up to PAIRS pairs
are matched by one task as they are. Optimality is proved afterwards by joins over the whole table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.tables import written


#: So many links, and pairs of a support, are looked at by one task; more links are thinned by many tasks first, and more pairs are matched component by component.
LINKS, PAIRS = 1 << 24, 1 << 24


def _least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b) in order, and the least node that each reaches.

    Labels hang below the least label next to them, chains are cut to their ends, and links between
    equal labels go, until none is left.
    """
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, a, b = np.arange(len(nodes)), places[: len(a)], places[len(a) :]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # ends are labels here, so no chain has a ring
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _star(batches, names: tuple[str, str]):
    """Nodes of a task's links (a, b), and the least that each reaches by these."""
    links = [x for x in batches if x.num_rows]
    if links:
        table = pa.Table.from_batches(links)
        found = _least_labels(table.column("a").to_numpy(), table.column("b").to_numpy())
        yield from pa.table(dict(zip(names, found))).to_batches()


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (the smallest node reached) for edges (a, b) and nodes (node).

    Up to LINKS links are labelled by one task. Of more, tasks keep what connects the nodes they
    see, as long as that takes away half of them; what is still more than LINKS is labelled in rounds.
    """
    links = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    if nodes is not None:
        nodes = nodes.select(F.col("node").cast("long").alias("node"))
    count = links.count()
    while count > LINKS:
        kept = links.repartition(-(-count // LINKS)).where("a is not null and b is not null").mapInArrow(lambda batches: _star(batches, ("a", "b")), "a long, b long")
        kept = written(kept.unionByName(links.where("a is null or b is null")), "links")
        before, count, links = count, kept.count(), kept
        if 2 * count > before:
            break
    if count > LINKS:
        return _connected_in_rounds(links, nodes)
    single = links.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a is not null")  # a link with one end says that it's there
    found = written(single.repartition(1).mapInArrow(lambda batches: _star(batches, ("node", "component")), "node long, component long"), "labels")  # bounded by LINKS
    if nodes is None:
        return found
    alone = nodes.where("node is not null").distinct().join(found.hint("shuffle_hash"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def _connected_in_rounds(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """connected() at any size.

    Labels sink to the least neighbour's label and then to their label's label, so paths halve
    each round; each round is written, and one flag reaches the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    every = both.select(F.col("a").alias("node"), F.least("a", "b").alias("mid"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node", F.col("node").alias("mid")))
    sunk = written(every.where("node is not null").groupBy("node").agg(F.min("mid").alias("mid")), "sunk")  # the first round: a neighbour's label is the neighbour
    while True:
        hop = sunk.select("node", "mid").join(sunk.select(F.col("node").alias("mid"), F.col("mid").alias("far")).hint("shuffle_hash"), "mid").select("node", F.least("mid", "far").alias("component"))
        labels = written(hop, "labels")
        least = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")).hint("shuffle_hash"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        sunk = labels.join(least.hint("shuffle_hash"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", F.col("component"))).alias("mid"))
        sunk = written(sunk, "sunk")
        if not sunk.where("mid <> old").take(1):  # no edge has two labels
            return labels


def bipartite_components(support: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    """side, id, component: of sources and targets, isolated ones too; components numbered by their smallest member, sources before targets."""
    spark = support.sparkSession
    nodes = spark.range(n_sources + n_targets).withColumnRenamed("id", "node")
    found = connected(support.select(F.col("source").alias("a"), (F.col("target") + n_sources).alias("b")), nodes)
    return found.select(F.when(F.col("node") < n_sources, "source").otherwise("target").alias("side"), F.when(F.col("node") < n_sources, F.col("node")).otherwise(F.col("node") - n_sources).alias("id"), "component")


def component_sizes(components: DataFrame, support: DataFrame) -> DataFrame:
    """component, sources, targets, edges, feasible (no more sources than targets)."""
    sizes = components.groupBy("component").agg(F.count_if(F.col("side") == "source").alias("sources"), F.count_if(F.col("side") == "target").alias("targets"))
    edges = support.join(components.where("side = 'source'").select(F.col("id").alias("source"), "component"), "source").groupBy("component").agg(F.count("*").alias("edges"))
    return sizes.join(edges, "component", "left").select("component", "sources", "targets", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("sources") <= F.col("targets")).alias("feasible"))


def component_plan(sizes: DataFrame) -> DataFrame:
    """component, edges, plan of component_sizes(): nothing to do where there is no source, infeasible where there are more sources than targets, else solve."""
    plan = F.when(F.col("sources") == 0, "nothing").when(F.col("sources") > F.col("targets"), "infeasible").otherwise("solve")
    return sizes.select("component", "sources", "targets", "edges", plan.alias("plan"))


def _with_component(support: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    own = bipartite_components(support, n_sources, n_targets).where("side = 'source'").select(F.col("id").alias("source"), "component")
    return support.join(own, "source")


# ---------------------------------------------------------------- maximum matching

def _entries(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' entries, of a table by rows, and of each the place in rows."""
    size = start[rows + 1] - start[rows]
    own = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size - start[rows], size), own


def _greedy_mates(source: np.ndarray, target: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Mates of n sources and of m targets (-1 if none) in a matching that no pair can join: in rounds, sources ask their rarest targets, and targets take who has the fewest."""
    mate, taken, turn = np.full(n, -1), np.full(m, -1), 0
    while len(source):
        few, turn = np.bincount(source, minlength=n), turn + 1
        key = (np.bincount(target, minlength=m)[target] << 20) + (target * 2654435761 + source * 40503 + turn * 97) % (1 << 20)  # equally rare ones in turn
        first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        asked = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, first), np.diff(np.r_[first, len(source)])))
        asked = asked[np.argsort(-few[source[asked]], kind="stable")]
        by, of = np.full(m, -1), np.full(n, -1)
        by[target[asked]] = source[asked]
        t = np.flatnonzero(by >= 0)
        of[by[t]] = t
        s = np.flatnonzero(of >= 0)
        mate[s], taken[of[s]] = of[s], s
        free = (mate[source] < 0) & (taken[target] < 0)
        source, target = source[free], target[free]
    return mate, taken


def _matched(source: np.ndarray, target: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Mates (-1 if none) of n sources in a maximum matching of different pairs in order, and whether alternating paths reach a source from unmatched ones.

    Trees of alternating paths grow from all unmatched sources at once, a layer at a time, and no two
    share a vertex. Where one finds a free target, its path is turned and the tree let go; the other
    trees stay, and grow on by what was let go, until none finds a free target. Then they are the region.
    """
    start, by = np.searchsorted(source, np.arange(n + 1)), np.argsort(target, kind="stable")
    back, back_start = source[by], np.searchsorted(target[by], np.arange(m + 1))
    mate, taken = _greedy_mates(source, target, n, m)
    root, parent, end = np.where(mate < 0, np.arange(n), -1), np.full(m, -1), np.full(n, -1)
    at, own = _entries(start, np.flatnonzero(mate < 0))
    s, t = np.flatnonzero(mate < 0)[own], target[at]
    while True:
        while len(s):
            fresh = parent[t] < 0
            s, t = s[fresh], t[fresh]
            parent[t] = s
            one = parent[t] == s
            s, t = s[one], t[one]
            other = taken[t]
            hit = other < 0
            end[root[s[hit]]] = t[hit]
            root[other[~hit]] = root[s[~hit]]
            layer = other[~hit]
            layer = layer[end[root[layer]] < 0]
            at, own = _entries(start, layer)
            s, t = layer[own], target[at]
        ended = np.flatnonzero(end >= 0)
        if not len(ended):
            return mate, root >= 0
        seen, held = np.flatnonzero(parent >= 0), np.flatnonzero(root >= 0)
        seen, held = seen[end[root[parent[seen]]] >= 0], held[end[root[held]] >= 0]
        turned = end[ended]
        while len(turned):
            s = parent[turned]
            before = mate[s]
            mate[s], taken[turned] = turned, s
            turned = before[before >= 0]
        parent[seen], root[held], end[ended] = -1, -1, -1
        at, own = _entries(back_start, seen)
        s, t = back[at], seen[own]
        near = root[s] >= 0
        s, t = s[near], t[near]


def _match_table(table: pa.Table) -> pa.Table:
    """source, target (null if unmatched), conflict of pairs (source, target)."""
    sources, s = np.unique(table.column("source").to_numpy(), return_inverse=True)
    targets, t = np.unique(table.column("target").to_numpy(), return_inverse=True)
    pairs = np.sort(s * len(targets) + t)  # np.unique is ten times slower
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
    mate, region = _matched(pairs // max(1, len(targets)), pairs % max(1, len(targets)), len(sources), len(targets))
    mates = pa.array(targets[mate] if len(targets) else mate, "int64", mask=mate < 0)
    return pa.table({"source": sources, "target": mates, "conflict": region})


def maximum_matching(rows: dict[int, list[int]]) -> tuple[dict[int, int], set[int]]:
    """Mates of sources in a maximum matching, and the sources that alternating paths reach from unmatched ones; sources without targets too."""
    pairs = [(s, t) for s, row in rows.items() for t in row]
    found = _match_table(pa.table({"source": pa.array([s for s, _ in pairs], "int64"), "target": pa.array([t for _, t in pairs], "int64")})).to_pylist()
    return {r["source"]: r["target"] for r in found if r["target"] is not None}, {r["source"] for r in found if r["conflict"]} | {s for s, row in rows.items() if not row}


def _match_all(batches):
    """_match_table() of all pairs of a task."""
    pairs = [x for x in batches if x.num_rows]
    if pairs:
        yield from _match_table(pa.Table.from_batches(pairs)).to_batches()


def matching(support: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    """source, target (null if unmatched), conflict for every source; conflict: an alternating path reaches it from an unmatched source.

    The region doesn't depend on which maximum matching was found. Sources without candidates are unmatched and in conflict.
    Up to PAIRS pairs are matched by one task, more by components.
    """
    pairs = support.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
    if pairs.count() <= PAIRS:
        found = pairs.repartition(1).mapInArrow(_match_all, "source long, target long, conflict boolean")  # bounded by PAIRS
    else:
        found = _with_component(pairs, n_sources, n_targets).groupBy("component").applyInArrow(lambda table: _match_table(table), "source long, target long, conflict boolean")
    every = support.sparkSession.range(n_sources).withColumnRenamed("id", "source")
    return every.join(found, "source", "left").select("source", "target", F.coalesce("conflict", F.lit(True)).alias("conflict"))


# ---------------------------------------------------------------- assignment

def solve(rows: dict[int, list[tuple[int, float]]]) -> tuple[dict[int, int], dict[int, float], dict[int, float]] | None:
    """Mates, source duals and target duals of a least-cost assignment of all sources; None if there is none.

    Shortest augmenting paths on reduced costs. Source duals start at each row's least cost; target
    duals only sink from zero, and stay zero where nothing is matched.
    """
    u = {s: min(c for _, c in row) for s, row in rows.items()}
    v: dict[int, float] = {}
    mate: dict[int, int] = {}
    taken: dict[int, int] = {}
    for s in sorted(rows):  # tight free targets first: no search
        for t, c in rows[s]:
            if t not in taken and c == u[s]:
                mate[s], taken[t] = t, s
                break
    for start in sorted(rows):
        if start in mate:
            continue
        distance: dict[int, float] = {}
        origin: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        s, base, end = start, 0.0, None
        while True:
            for t, c in rows[s]:
                if t not in done:
                    d = base + c - u[s] - v.get(t, 0.0)
                    if d < distance.get(t, float("inf")):
                        distance[t], origin[t] = d, s
                        heapq.heappush(heap, (d, t))
            while heap and (heap[0][1] in done or heap[0][0] > distance[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                return None
            base, t = heapq.heappop(heap)
            done[t] = base
            if t not in taken:
                end = t
                break
            s = taken[t]
        u[start] += base
        for t, d in done.items():
            if t != end:
                u[taken[t]] += base - d
                v[t] = v.get(t, 0.0) - (base - d)
        t = end
        while True:
            s = origin[t]
            taken[t] = s
            mate[s], t = t, mate.get(s)
            if s == start:
                break
    return mate, u, v


def _solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
    rows: dict[int, list[tuple[int, float]]] = {}
    for s, t, c in sorted(zip(pdf["source"].tolist(), pdf["target"].tolist(), pdf["cost"].tolist())):
        rows.setdefault(s, []).append((t, c))
    found = solve(rows)
    if found is None:
        return pd.DataFrame({"source": list(rows), "target": pd.array([None] * len(rows), "Int64"), "u": float("nan"), "v": float("nan")})
    mate, u, v = found
    return pd.DataFrame([(s, mate[s], u[s], v.get(mate[s], 0.0)) for s in rows], columns=["source", "target", "u", "v"]).astype({"target": "Int64"})


def assignment(costs: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    """source, target, cost, u, v for every source: a least-cost one-to-one assignment; nulls where a component has none, or a source no candidate."""
    parts = written(bipartite_components(costs, n_sources, n_targets), "components")
    plan = component_plan(component_sizes(parts, costs)).where("plan = 'solve'").select("component")
    own = parts.where("side = 'source'").select(F.col("id").alias("source"), "component").join(plan, "component", "left_semi")
    rows = costs.select("source", "target", "cost").join(own, "source")
    found = rows.groupBy("component").applyInPandas(_solve_group, "source long, target long, u double, v double")
    every = costs.sparkSession.range(n_sources).withColumnRenamed("id", "source")
    out = every.join(found, "source", "left").join(costs.select("source", "target", "cost"), ["source", "target"], "left")
    return written(out.select("source", "target", "cost", F.nanvl("u", F.lit(None)).alias("u"), F.nanvl("v", F.lit(None)).alias("v")), "assignment")


def certificate(costs: DataFrame, assigned: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: sources, matched, one_to_one, primal, dual feasibility and slackness, objectives, optimal.

    Dual: u + v <= c on all pairs and v <= 0; slackness: u + v = c where matched; no duality gap.
    """
    duals_v = assigned.where("target is not null").select("target", "v")
    slack = costs.select("source", "target", "cost").join(assigned.select("source", "u"), "source").join(duals_v, "target", "left")
    below = slack.agg(F.coalesce(F.min(F.col("cost") - F.col("u") - F.coalesce("v", F.lit(0.0))), F.lit(0.0)).alias("least_slack"))
    sums = assigned.agg(
        F.count("*").alias("sources"),
        F.count("target").alias("matched"),
        (F.count("target") == F.count_distinct("target")).alias("one_to_one"),
        F.sum(F.col("cost").cast("decimal(28,9)")).cast("double").alias("primal"),
        F.sum((F.col("u") + F.col("v")).cast("decimal(28,9)")).cast("double").alias("dual"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("most_v"),
        F.coalesce(F.max(F.abs(F.col("cost") - F.col("u") - F.col("v"))), F.lit(0.0)).alias("most_loose"),
    )
    row = sums.crossJoin(F.broadcast(below))  # one row each
    gap = F.abs(F.coalesce(F.col("primal") - F.col("dual"), F.lit(0.0)))
    limit = tolerance * F.greatest(F.lit(1.0), F.col("sources").cast("double"))
    complete = F.col("matched") == F.col("sources")
    dual_ok = (F.col("least_slack") >= -tolerance) & (F.col("most_v") <= tolerance)
    return row.select(
        "sources", "matched", complete.alias("complete"), "one_to_one", F.round("primal", 6).alias("primal"), dual_ok.alias("dual_feasible"), (F.col("most_loose") <= tolerance).alias("tight"),
        (complete & F.col("one_to_one") & dual_ok & (F.col("most_loose") <= tolerance) & (gap <= limit + 1e-6)).alias("optimal"),
    )


def zero_cost(costs: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: least cost on the support, the assignment's total, and whether that alone proves it: no cost is negative, all are matched, the total is zero."""
    one = costs.agg(F.min("cost").alias("least_cost"))
    two = assigned.agg(F.count("*").alias("sources"), F.count("target").alias("matched"), F.coalesce(F.sum(F.col("cost").cast("decimal(28,9)")).cast("double"), F.lit(0.0)).alias("total"))
    row = two.crossJoin(F.broadcast(one))  # one row each
    return row.select(F.round("least_cost", 6).alias("least_cost"), F.round("total", 6).alias("total"), ((F.col("least_cost") >= 0) & (F.col("matched") == F.col("sources")) & (F.col("total") == 0)).alias("proved"))


def greedy_rest(costs: DataFrame, taken: DataFrame, n_sources: int, n_targets: int) -> DataFrame:
    """source, target: the pairs taken (greedily, say), and a least-cost assignment of the other sources to targets that are still free."""
    rest = costs.join(taken.select("source"), "source", "left_anti").join(taken.select("target"), "target", "left_anti")
    more = assignment(written(rest.select("source", "target", "cost"), "rest"), n_sources, n_targets).where("target is not null")
    return taken.select("source", "target").unionByName(more.select("source", "target"))
