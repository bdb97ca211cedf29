"""Operators against golden values, small independent implementations and brute force."""

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.scores import FEATURES
from vertexloom.operators import assign, baselines, candidates, costs, evaluate, features, soft, support
from vertexloom.operators import graph as graphs
from vertexloom.plans.matching import MatchConfig, match, prepare
from vertexloom.sources import files, named
from vertexloom.streaming.arriving import match_arriving
from vertexloom.tables import written


@pytest.fixture(scope="module")
def toy(spark):
    return graphs.toy_pair(spark)


def test_toy_features(toy):
    rows = {r.v: r for r in features.structural(toy[0]).collect()}
    assert [rows[v].degree for v in range(6)] == [2, 4, 3, 3, 2, 2]
    assert [rows[v].triangles for v in range(6)] == [0, 2, 1, 2, 1, 0]
    assert rows[1].clustering == pytest.approx(1 / 3) and rows[4].clustering == 1
    assert [rows[v].avg_nd for v in range(6)] == pytest.approx([3, 2.5, 3, 3, 3.5, 2.5])
    assert [rows[v].nd_std for v in range(6)] == pytest.approx([1.414214, 0.57735, 1, 1, 0.707107, 0.707107], abs=1e-6)


def test_toy_optimum_is_the_least_of_all_permutations(toy):
    one, two, truth = toy
    result = match(prepare(one), prepare(two), MatchConfig(k=6, confidences=True))
    assert result.status == "optimal" and result.notes["matching"] == 6
    table = {(r.source, r.target): r.cost for r in costs.costs(result.candidates).collect()}
    least = min(sum(table[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(6)))
    assert result.certificate.first().primal == pytest.approx(least, abs=1e-6)
    assert {(r.source, r.target) for r in result.assignment.collect()} == {(r.source, r.target) for r in truth.collect()}
    kept = evaluate.preservation(one, two, truth).first()
    assert kept.forward == kept.backward == 1 and kept.qap_cost == 0


def test_isolated_vertex_and_bad_graphs(spark):
    none = spark.createDataFrame([], "u long, v long")
    lonely = graphs.build(spark.range(1).withColumnRenamed("id", "v"), none)
    assert tuple(features.structural(lonely).first())[1:] == (0,) * 6
    assert features.profiles(lonely, 3).first().profile == [0, 0, 0]
    three = spark.range(3).withColumnRenamed("id", "v")
    for edges in ([(0, 0)], [(0, 1), (1, 0)], [(0, 3)]):
        with pytest.raises(ValueError):
            graphs.build(three, spark.createDataFrame(edges, "u long, v long"))
    with pytest.raises(ValueError):
        graphs.build(three.limit(0), none)


def test_top_k_ties_and_bounds(spark, toy):
    flat = toy[0].vertices.select("v", *[F.lit(0.0).alias(f) for f in features.FEATURES])
    found = candidates.exhaustive(flat, flat, 3)
    assert {tuple(r.target for r in g) for _, g in itertools.groupby(found.orderBy("source", "rank").collect(), key=lambda r: r.source)} == {(0, 1, 2)}
    for k in (0, 7):
        with pytest.raises(ValueError):
            candidates.exhaustive(flat, flat, k)
    with pytest.raises(ValueError):
        candidates.exhaustive(flat, flat, 1, weights={"degree": -1.0})
    odd = spark.createDataFrame([(0, 1, float("nan"))], "pool long, target long, score double")
    with pytest.raises(Exception):
        candidates.select_top(odd, 1).collect()
    assert candidates.select_top(odd.limit(0), 5).count() == 0


def test_index_plans_equal_shell_loop(spark):
    r = random.Random(5)
    rows = [(v, float(r.randrange(30)), float(r.randrange(30))) for v in range(60)]
    raw = spark.createDataFrame([(v, d, 0.0, a, 0.0, 0.0, 0.0) for v, d, a in rows], "v long, degree double, clustering double, avg_nd double, nd_std double, triangles double, degree_sq double")
    config = candidates.IndexConfig(0.3, 0.3, 1, 2, 3)
    cell = {v: (math.floor(math.log(1 + d) / 0.3), math.floor(math.log(1 + a) / 0.3)) for v, d, a in rows}
    for p in candidates.plan(raw, raw, 4, config).collect():
        pools = [sum(max(abs(cell[p.source][0] - x), abs(cell[p.source][1] - y)) <= radius for x, y in cell.values()) for radius in range(3)]
        stop = next((x for x in range(1, 3) if pools[x] >= 12), None)
        assert (p.radius, p.pool, p.fallback) == (2 if stop is None else stop, pools[2 if stop is None else stop], stop is None and pools[2] < 12)
    every = candidates.retrieved(candidates.plan(raw, raw, 100, config), raw, config)
    assert every.count() == 60 * 60  # more are wanted than there are: all fall back
    for bad in ({"degree_width": 0.0}, {"min_radius": 3, "max_radius": 2}, {"multiplier": 0}):
        with pytest.raises(ValueError):
            candidates.IndexConfig(**bad)


def _least(rows, n):
    best = math.inf
    table = {i: dict(row) for i, row in rows.items()}
    targets = sorted({t for row in rows.values() for t, _ in row})
    for perm in itertools.permutations(targets, n) if len(targets) >= n else ():
        if all(t in table.get(i, {}) for i, t in enumerate(perm)):
            best = min(best, sum(table[i][t] for i, t in enumerate(perm)))
    return best


def test_assignment_equals_brute_force_and_duals_prove_it():
    r = random.Random(1)
    for _ in range(200):
        n, m = r.randrange(1, 6), r.randrange(1, 7)
        rows = {i: [(j, float(r.randrange(-5, 6))) for j in range(m) if r.random() < 0.5] for i in range(n)}
        want = _least(rows, n) if all(rows.values()) else math.inf
        found = assign.solve(rows) if all(rows.values()) else None
        if want == math.inf:
            assert found is None
            continue
        mate, u, v = found
        assert len(set(mate.values())) == n and sum(dict(rows[i])[t] for i, t in mate.items()) == pytest.approx(want)
        assert all(c - u[i] - v.get(j, 0) > -1e-9 for i, row in rows.items() for j, c in row) and all(x <= 1e-9 for x in v.values())
        assert all(v.get(j, 0) == 0 or j in mate.values() for j in range(m))


def test_maximum_matching_and_conflicts_equal_brute_force():
    r = random.Random(2)
    for _ in range(200):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        rows = {i: [j for j in range(m) if r.random() < 0.4] for i in range(n)}
        mate, region = assign.maximum_matching(rows)
        assert len(set(mate.values())) == len(mate) and all(t in rows[s] for s, t in mate.items())

        def most(sources):
            best = 0
            for size in range(len(sources), 0, -1):
                for chosen in itertools.combinations(sources, size):
                    for p in itertools.permutations(range(m), size):
                        if all(t in rows[s] for s, t in zip(chosen, p)):
                            return size
            return best

        assert len(mate) == most(range(n))
        whole = len(mate)
        assert region == {s for s in range(n) if most([x for x in range(n) if x != s]) == whole}


def test_repair(spark):
    rows = [(0, 0, 0, 0.9), (1, 0, 0, 0.9), (2, 0, 2, 0.9)]
    full = {0: [0, 1, 2], 1: [0, 1, 2], 2: [2, 1, 0]}
    start = spark.createDataFrame(rows, "source long, rank int, target long, similarity double")
    prefix = lambda s, k: spark.createDataFrame([(i, j, t, 1.0 - j / 10) for i in full for j, t in enumerate(full[i][:k])], start.schema).join(s, "source", "left_semi")
    grown, why, history = support.repair(start, 3, 3, 1, prefix)
    assert why == "feasible" and grown.count() == 5 and grown.where("source = 2").count() == 1 and len(history) == 2
    stuck = lambda s, k: spark.createDataFrame([(i, j, j, 0.5) for i in range(3) for j in range(min(k, 2))], start.schema).join(s, "source", "left_semi")
    first = spark.createDataFrame([(i, 0, 0, 0.5) for i in range(3)], start.schema)
    grown, why, history = support.repair(first, 3, 2, 1, stuck)
    assert why == "prefix_limit" and history[-1]["matching"] == 2 and grown.count() == 6


def test_components_and_rectangular_assignment(spark):
    table = spark.createDataFrame([(0, 0, 1.0), (0, 2, 0.5), (1, 2, 0.1), (2, 1, 3.0)], "source long, target long, cost double")
    comp = {(r.side, r.id): r.component for r in assign.bipartite_components(table, 3, 4).collect()}
    assert comp == {("source", 0): 0, ("source", 1): 0, ("target", 0): 0, ("target", 2): 0, ("source", 2): 2, ("target", 1): 2, ("target", 3): 6}
    out = assign.assignment(table, 3, 4)
    assert {(r.source, r.target) for r in out.collect()} == {(0, 0), (1, 2), (2, 1)} and assign.certificate(table, out).first().optimal
    short = assign.assignment(table.where("source <> 2"), 3, 4)
    row = assign.certificate(table, short).first()
    assert row.matched == 2 and not row.complete and not row.optimal


def test_scaling(spark):
    rows = spark.createDataFrame([(0, 0, 0.05), (0, 1, 0.2), (1, 0, 0.2), (1, 1, 0.05)], "source long, target long, cost double")
    shares, notes = soft.sinkhorn(rows, 0.1, 500, 1e-8)
    assert notes["status"] == "converged" and all(s == pytest.approx(1) for s, in shares.groupBy("source").agg(F.sum("probability")).select("sum(probability)").collect())
    far = rows.withColumn("cost", F.lit(1e6) + F.col("cost") * 0)
    assert [r.probability for r in soft.sinkhorn(far, 1e-3)[0].collect()] == pytest.approx([0.5] * 4)
    assert soft.sinkhorn(rows.where("source = 0"))[1]["status"] == "not_square"


def test_greedy_equals_the_sequence(spark):
    r = random.Random(3)
    rows = [(i, j, r.randrange(5) / 4) for i in range(12) for j in range(10) if r.random() < 0.4]
    taken, a, b = set(), set(), set()
    for i, j, v in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if i not in a and j not in b:
            taken.add((i, j))
            a.add(i)
            b.add(j)
    found = soft.greedy(spark.createDataFrame(rows, "source long, target long, similarity double"))
    assert {(x.source, x.target) for x in found.collect()} == taken


def test_core_numbers_and_generators(spark):
    r = random.Random(4)
    edges = sorted({tuple(sorted(r.sample(range(15), 2))) for _ in range(40)})
    g = graphs.Graph(spark.range(15).withColumnRenamed("id", "v"), spark.createDataFrame(edges, "u long, v long"))
    left, core = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in range(15)}, {}
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        core[v] = max(len(left[v]), max(core.values(), default=0))
        for o in left.pop(v):
            left[o].discard(v)
    assert {x.v: x.core for x in features.core_numbers(g).collect()} == core
    assert graphs.random_edges(spark, 10, 20, 1).edges.distinct().count() == 20
    assert graphs.grid(spark, 3, 4).edges.count() == 17
    assert graphs.preferential(spark, 20, 3).edges.distinct().count() == 17 * 3 and graphs.small_world(spark, 20, 4, 0.3).edges.distinct().count() == 40
    assert graphs.block_model(spark, [5, 6], 1.0, 0.0).edges.count() == 10 + 15
    assert graphs.within_reach(graphs.grid(spark, 3, 4), 0, 3).edges.count() == 2
    biggest, mapping = files.largest_component(graphs.block_model(spark, [5, 6], 1.0, 0.0))
    assert biggest.vertices.count() == 6 and biggest.edges.count() == 15 and mapping.count() == 6
    k = graphs.rmat(spark, 5, 4)
    assert k.edges.where("u >= v or v >= 32").count() == 0 and k.edges.count() > 50
    copy, truth = graphs.paired(g, 0.1, 7)
    assert copy.edges.count() == len(edges) and truth.select("target").distinct().count() == 15
    kept = evaluate.preservation(g, copy, truth).first().kept
    assert kept == len(edges) - int(len(edges) * 0.1)
    flips = spark.createDataFrame([(*edges[0],), (0, 0), (1, 1)], "a long, b long")
    assert graphs.flipped(g, flips).edges.count() == len(edges) - 1


def test_measures(spark, toy):
    path = graphs.Graph(spark.range(3).withColumnRenamed("id", "v"), spark.createDataFrame([(0, 1), (1, 2)], "u long, v long"))
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "source long, target long")
    back = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "source long, target long")
    assert evaluate.accuracy(back, truth).first().accuracy == pytest.approx(1 / 3, abs=1e-6)
    assert evaluate.preservation(path, path, back).first().forward == 1
    part = back.where("source < 2")
    support_rows = spark.createDataFrame([(0, 2, 0.5), (1, 1, 1.0)], "source long, target long, similarity double")
    row = evaluate.mapping_report(part, support_rows, truth).first()
    assert row.accuracy is None and row.cost is None and row.matched == 2 and row.on_support == 2
    assert evaluate.accuracy(part, truth).first().accuracy_matched == 0.5
    assert evaluate.one_to_one(back, 3).first()[0] and not evaluate.one_to_one(back, 2).first()[0]
    assert evaluate.recall(support_rows, truth).first().found == 1
    empty = graphs.Graph(path.vertices, path.edges.limit(0))
    assert evaluate.preservation(empty, path, back).first().forward == 1


def test_signed_rank_equals_all_signs(spark):
    r = random.Random(6)
    rows = [("a", 1.0 + i, 1.0 + i + r.choice([-1, 1, 1]) * (i + 1) / 8) for i in range(9)]  # no ties
    rows += [("b", 0.5, 0.5), ("b", 1.0, 0.5), ("b", 0.5, 1.0), ("b", 3.0, 1.0), ("b", None, 1.0), ("c", 1.0, 1.0)]
    found = {x.k: x for x in evaluate.signed_rank(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    signs = [1 if x > y else -1 for k, x, y in rows if k == "a"]
    plus = sum(i + 1 for i, s in enumerate(signs) if s > 0)
    low = min(plus, 45 - plus)
    sums = [sum(i + 1 for i, s in enumerate(way) if s) for way in itertools.product((0, 1), repeat=9)]
    assert (found["a"].pairs, found["a"].w_plus, found["a"].statistic) == (9, plus, low)
    assert found["a"].p == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / len(sums)))
    b = found["b"]
    assert (b.pairs, b.zeros, b.w_plus, b.w_minus) == (3, 1, 4.5, 1.5)
    z = (4.5 - 3) / math.sqrt((3 * 4 * 7 - (8 - 2) / 2) / 24)
    assert b.z == pytest.approx(z, abs=1e-6) and b.p == pytest.approx(math.erfc(z / math.sqrt(2))) and b.mark == "ns"
    assert (found["c"].pairs, found["c"].zeros, found["c"].p, found["c"].mark) == (0, 1, None, None)


def test_named_graphs(spark):
    for name, n, m, most, triangles in (("karate", 34, 78, 17, 45), ("florentine", 15, 20, 6, 3), ("davis", 32, 89, 14, 0)):
        g = named.named_graph(spark, name)
        assert g.vertices.count() == n and g.edges.where("u < v").distinct().count() == m
        row = features.structural(g).agg(F.max("degree"), F.sum("triangles")).first()
        assert tuple(row) == (most, 3 * triangles)
    with pytest.raises(ValueError):
        named.named_graph(spark, "none")


def test_swaps_never_lose_edges():
    edges = [(0, 1), (1, 2), (2, 3), (3, 4)]
    start = {0: 1, 1: 0, 2: 2, 3: 4, 4: 3}
    kept = lambda m: sum(tuple(sorted((m[u], m[v]))) in edges for u, v in edges)
    out, gain = soft.swap_refined(edges, edges, start, {i: set(range(5)) for i in range(5)}, 500)
    assert kept(out) == kept(start) + gain and gain > 0 and sorted(out.values()) == list(range(5))
    assert soft.swap_refined(edges, edges, start, {}, 100) == (start, 0)


def test_dense_baselines():
    r = np.random.default_rng(0)
    a = np.triu(r.random((12, 12)) < 0.4, 1).astype(float)
    a += a.T
    p = r.permutation(12)
    b = np.zeros_like(a)
    b[np.ix_(p, p)] = a
    for name in ("frank_wolfe", "least_distance", "reweighted_walk", "graduated", "spectral", "feature_lap", "degree_lap"):
        assert sorted(getattr(baselines, name)(a, b)) == list(range(12))
    assert (baselines.least_distance(a, b) == p).mean() > 0.9
    s = r.random((6, 6))
    best = max(sum(s[i, x] for i, x in enumerate(q)) for q in itertools.permutations(range(6)))
    assert s[np.arange(6), baselines.lap(s)].sum() == pytest.approx(best)
    assert s[np.arange(6), baselines.auction(s)].sum() >= best - 6e-3
    assert sorted(baselines.greedy(s)) == list(range(6))
    assert baselines.sinkhorn(s).sum(axis=0) == pytest.approx(np.ones(6))
    assert baselines.dense_bytes(10) == 400 and baselines.sparse_bytes(10, 5) == 200 and not baselines.fits(100, 1000)


def test_soft_match_and_legacy(spark, toy):
    one, two, truth = toy
    a, b = features.normalised_pair(features.structural(one), features.structural(two))
    found = soft.soft_match(one, two, candidates.exhaustive(a, b, 4), 1, 2)
    rows = found.collect()
    assert len(rows) == len({r.target for r in rows}) == 6
    assert features.legacy(one, 2).count() == 6
    assert features.unflat(features.flat(a)).collect() == a.collect()


def test_files(spark, toy, tmp_path):
    one, _, truth = toy
    files.write_graph(one, str(tmp_path / "g"))
    again = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(again.edges.collect()) == sorted(one.edges.collect()) and again.vertices.count() == 6
    (tmp_path / "bad.txt").write_text("# c\n3 2\n0 1\n")
    with pytest.raises(ValueError):
        files.read_graph(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "raw.txt").write_text("# ids\n10 20\n20 10\n7 7\n20\t30\nx y\n")
    graph, mapping = files.read_edge_list(spark, str(tmp_path / "raw.txt"))
    assert {(r.original, r.v) for r in mapping.collect()} == {(10, 0), (20, 1), (30, 2)} and graph.edges.count() == 2
    files.convert(spark, str(tmp_path / "raw.txt"), str(tmp_path / "native"))
    assert files.read_graph(spark, str(tmp_path / "native")).edges.count() == 2
    rows = spark.createDataFrame([(0, 0, 1, 0.5), (1, 0, 0, 0.25)], files.CANDIDATES)
    files.write_csv(rows, str(tmp_path / "c"), "source", "rank")
    assert files.read_candidates(spark, str(tmp_path / "c"), 2, 2).count() == 2
    with pytest.raises(ValueError):
        files.read_candidates(spark, str(tmp_path / "c"), 1, 2)
    files.write_csv(truth.select(F.col("source").alias("source_vertex"), F.col("target").alias("target_vertex")), str(tmp_path / "t"), "source_vertex")
    assert sorted(files.read_mapping(spark, str(tmp_path / "t")).collect()) == sorted(truth.collect())
    files.write_assignment(spark.createDataFrame([(0, None, None)], files.ASSIGNMENT), str(tmp_path / "a"))
    assert tuple(files.read_csv(spark, str(tmp_path / "a"), files.ASSIGNMENT).first()) == (0, -1, -1.0)
    assert len(files.fingerprints(spark, str(tmp_path / "raw.txt")).first().sha256) == 64
    assert json.loads(files.metrics_json({"a": None})) == {"a": None} and files.registry(spark).count() == 15


def test_arriving_graphs(spark, toy, tmp_path):
    one, two, truth = toy
    two.edges.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("u long, v long").parquet(str(tmp_path / "in"))
    match_arriving(stream, prepare(one), 6, lambda rows, batch: seen.extend(rows.collect()), str(tmp_path / "ckpt"), MatchConfig(k=1)).awaitTermination()
    assert {(r.target, r.source) for r in seen} == {(r.source, r.target) for r in truth.collect()}


def _graph(spark, n, edges):
    return graphs.Graph(spark.range(n).withColumnRenamed("id", "v"), spark.createDataFrame(edges, "u long, v long"))


def test_edges_laid_on_each_other_count_once_backwards(spark):
    star, other = _graph(spark, 4, [(0, 1), (0, 2), (0, 3)]), _graph(spark, 4, [(0, 1)])
    folded = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "source long, target long")
    row = evaluate.preservation(star, other, folded).first()
    assert (row.kept, row.kept_back, row.forward, row.backward, row.qap_cost) == (3, 1, 1.0, 1.0, None)
    whole = spark.createDataFrame([(i, i) for i in range(4)], "source long, target long")
    assert evaluate.preservation(star, other, whole).first().qap_cost == 2 * (3 + 1 - 2)
    assert evaluate.permutation(whole, 4).first().permutation and not evaluate.permutation(folded, 4).first().permutation
    assert {(r.source, r.target) for r in evaluate.inverse(folded).collect()} == {(0, 0), (1, 3)}


def test_repair_stops_at_the_limit_that_comes_first_by_source(spark):
    rows = [(s, 0, 0, 1.0) for s in range(3)]
    start = spark.createDataFrame(rows, "source long, rank int, target long, similarity double")
    more = lambda s, k: s.join(spark.createDataFrame([(i, r, r, 1.0 - r / 10) for i in range(3) for r in range(k)], "source long, rank int, target long, similarity double"), "source")
    stop = lambda **limits: support.repair(start, 3, 4, 1, more, **limits)[1]
    assert stop(max_edges=12) == "feasible" and stop(max_bytes=8 * 5) == "payload_limit"
    assert stop(max_edges=4, max_bytes=8 * 6) == "candidate_limit"  # the second source has too many edges before the third lacks room
    kept, why, history = support.repair(start, 3, 4, 1, more, max_edges=5)
    assert why == "candidate_limit" and kept.count() == 3 and len(history) == 1
    with pytest.raises(ValueError):
        support.repair(start, 3, 4, 0, more)


def test_scaling_says_why_it_stopped(spark):
    of = lambda rows, **options: soft.sinkhorn(spark.createDataFrame(rows, "source long, target long, cost double"), **options)[1]["status"]
    square = [(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.1)]
    assert of(square) == "converged" and of(square, rounds=1, tolerance=0.0) == "round_limit"
    assert of(square, n=3) == "invalid_support" and of(square[:2]) == "not_square" and of([*square[:3], (1, 1, float("nan"))]) == "numerical_failure"
    assert of([(0, 0, 2000.0), (1, 1, 0.0)]) == "converged"  # far below what exp() can hold


def test_reduced_assignment_has_no_size_limit(spark):
    n = 600
    scores = spark.createDataFrame([(i, j % n, 0.3 if j == i else 0.29) for i in range(n) for j in (i, i + 1)], "source long, target long, similarity double")
    none = spark.createDataFrame([], "source long, target long, value double")
    found = soft.reduced_assignment(scores, none, 0.5)
    assert {(r.source, r.target) for r in found.collect()} == {(i, i) for i in range(n)}
    one = spark.createDataFrame([(0, 1, 0.2)], "source long, target long, value double")
    assert (0, 1) in {(r.source, r.target) for r in soft.reduced_assignment(scores.where("source < 3"), one, 0.5, ambiguous="unmatched", exact=False).collect()}


def test_generated_graphs_have_the_edges_that_they_promise(spark):
    dense = _graph(spark, 8, [(i, j) for i in range(8) for j in range(i + 1, 8)][:24])
    two, truth = graphs.paired(dense, 0.5, 3)
    assert two.edges.count() == 12 + 4 and graphs.violations(two.vertices, two.edges).first().repeated == 0 and truth.select("target").distinct().count() == 8
    assert graphs.random_edges(spark, 9, 36, 1).edges.distinct().count() == 36
    blocks = graphs.block_model(spark, [20, 30], 0.5, 0.1)
    inside = blocks.edges.where("(u < 20) = (v < 20)").count()
    assert inside == 95 + 218 and blocks.edges.count() == inside + 60 and graphs.violations(blocks.vertices, blocks.edges).first().n_edges == inside + 60
    assert set(graphs.variants(dense, (0.0, 0.1), (1,))) == {(1, 0.0), (1, 0.1)}


def test_prepared_pairs_and_stages_are_written(spark, tmp_path):
    g = _graph(spark, 5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    ids = spark.createDataFrame([(10 * i, i) for i in range(5)], "original long, v long")
    manifest = files.write_pairs(g, ids, f"file://{tmp_path}/pairs", "path", (0.0,), (11, 22))
    assert [p["seed"] for p in manifest["pairs"]] == [11, 22] and manifest["num_undirected_edges"] == 4
    target = files.read_graph(spark, f"file://{tmp_path}/pairs/seed_11/noise_00/target.graph")
    truth = files.read_mapping(spark, f"file://{tmp_path}/pairs/seed_11/noise_00/ground_truth.csv")
    assert evaluate.preservation(g, target, truth).first().forward == 1
    stages = files.Stages()
    with stages.stage("features", rows=5):
        pass
    with pytest.raises(RuntimeError), stages.stage("fails"):
        raise RuntimeError
    told = json.loads(stages.document(dataset="path"))
    assert [s["stage"] for s in told["stages"]] == ["features", "fails"] and told["stages"][1]["seconds"] is None and told["dataset"] == "path"
    assert {r.id for r in files.registry(spark).collect()} == {f"G{i}" for i in range(1, 16)}


def test_zero_cost_and_eigenvectors(spark, toy):
    table = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0), (1, 0, 2.0)], "source long, target long, cost double")
    assert assign.zero_cost(table, assign.assignment(table, 2, 2)).first().proved
    assert not assign.zero_cost(table.where("source = 0 or cost > 0"), assign.assignment(table.where("source = 0 or cost > 0"), 2, 2)).first().proved
    rows = {r.v: r for r in features.eigenvectors(toy[0], 2).collect()}
    assert sum(r.e1**2 for r in rows.values()) == pytest.approx(1) and len(rows) == 6
    assert len(features.rich(toy[0]).columns) == 1 + 8 + 8


def test_presets_match_softly(toy):
    from vertexloom.plans.matching import PRESETS, match_softly

    one, two, _ = toy
    found = match_softly(prepare(one), prepare(two), "realtime").collect()
    assert len({r.source for r in found}) == len({r.target for r in found}) == len(found) and PRESETS["batch"].k == 32


@pytest.mark.parametrize("profile_weight", [0.0, 0.25])
def test_block_top_equals_brute_force_with_copies_and_leaves(profile_weight):
    r = np.random.default_rng(3)
    terms = [(f, w) for f, w in zip(FEATURES, (1.0, 2.0, 0.5, 1.0, 1.0, 1.0))]

    def side(n):
        rows = np.round(r.normal(size=(n, 6)), 1)
        rows[: n // 4, 1:] = 0.0  # many of one direction, which tie
        rows[0] = 0.0
        return rows, r.integers(0, 3, (n, 4)) / 2.0

    (x, px), (y, py) = side(200), side(3000)
    frame = lambda v, p: pd.DataFrame(v, columns=list(FEATURES)).assign(profile=list(p))
    a, b = frame(x, px).assign(source=np.arange(200)), frame(y, py).assign(targets=[np.array([2 * i, 2 * i + 6001]) for i in range(3000)])
    found = candidates._block_top(a, b, 5, terms, profile_weight).sort_values(["source"], kind="stable")
    w = np.array([w for _, w in terms])
    size = np.sqrt((x * x * w).sum(1))[:, None] * np.sqrt((y * y * w).sum(1))
    value = np.where(size < 1e-12, 0.0, (x[:, None] * w * y).sum(2) / np.where(size < 1e-12, 1.0, size)).clip(-1, 1)
    if profile_weight:
        value = value + profile_weight * np.maximum(0.0, 1 - np.abs(px[:, None] - py).sum(2) / 4)
    ids, value = np.concatenate([2 * np.arange(3000), 2 * np.arange(3000) + 6001]), np.hstack([value, value])
    for i, rows in found.groupby("source"):
        best = np.lexsort((ids, -np.round(value[i], 9)))[:5]
        assert rows["target"].tolist() == ids[best].tolist() and np.allclose(rows["similarity"], value[i][best], atol=1e-12)
    assert found["source"].nunique() == 200 and len(found) == 1000


def test_exhaustive_scores_equal_rows_once(spark, monkeypatch):
    """Of 6,000 vertices with 30 different rows each side, tasks get 30 sources and 30 targets; candidates are those of all pairs."""
    sizes = {}

    def spied(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(candidates, "written", spied)
    rows = spark.range(6000).select(F.col("id").alias("v"), *[F.cos((F.col("id") % 30) * (i + 1)).alias(f) for i, f in enumerate(FEATURES)])
    found = candidates.exhaustive(rows, rows, 3).where("source in (7, 5990)").orderBy("source", "rank").collect()
    assert sizes == {"alike": 30, "few": 30}
    assert [(x.source, x.rank, x.target) for x in found] == [(7, 0, 7), (7, 1, 37), (7, 2, 67), (5990, 0, 20), (5990, 1, 50), (5990, 2, 80)]


@pytest.mark.parametrize("chunk", [None, 4])
def test_products_block_by_block_equal_all_pairs(monkeypatch, chunk):
    """Three blocks of places, with copies: what a block gives holds the k best of each pool (and chunk)."""
    monkeypatch.setattr(candidates, "POOL_BLOCK", 8)
    r, n, k = np.random.default_rng(5), 21, 2
    e = r.integers(-2, 3, (n, 3)).astype(float)
    rows = pd.DataFrame({"id": 10 * np.arange(n), "place": np.arange(n), "e": list(e)})
    found = []
    for tb in range(3):
        b = rows[rows["place"].between(8 * tb, 8 * tb + 7 + (chunk is not None))].assign(tb=tb)
        found += candidates._product_best(rows, b, k, chunk).itertuples(index=False)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        groups = {}
        for place, j in enumerate(others):
            groups.setdefault(place // chunk if chunk else 0, []).append(j)
        for g, js in groups.items():
            want = sorted((-(e[i] @ e[j]), 10 * j) for j in js)[:k]
            got = sorted((-x.product, x.target) for x in found if x.pool == 10 * i and (chunk is None or x.chunk == g))
            assert got[:k] == want and 10 * i not in [t for _, t in got]


def test_retrieved_counts_equal_the_pairs(spark):
    raw = spark.range(40).select(F.col("id").alias("v"), (F.col("id") % 7 * 3).cast("double").alias("degree"), (F.col("id") % 5 * 4).cast("double").alias("avg_nd"))
    for k in (2, 100):
        config = candidates.IndexConfig(0.5, 0.5, 1, 2, 4)
        plans = candidates.plan(raw, raw, k, config)
        want = candidates.retrieved(plans, raw, config).groupBy("source").count().orderBy("source").collect()
        got = candidates.retrieved_counts(plans, raw, config).orderBy("source").collect()
        assert [tuple(x) for x in got] == [tuple(x) for x in want] and len(got) == 40


def test_block_consistency_equals_brute_force():
    r = random.Random(4)
    edges = [{(u, v) for u in range(12) for v in range(12) if u < v and r.random() < 0.4} for _ in range(2)]
    near = [{u: [v for v in range(12) if (min(u, v), max(u, v)) in e] for u in range(12)} for e in edges]
    held = {s: {t: r.randrange(10**12) for t in r.sample(range(12), 3)} for s in range(10)}
    arcs = [(i, list(held[s]), list(held[s].values())) for i in range(12) for s in near[0][i] if s in held]
    mine = [(i, j, near[1][j]) for i in range(12) for j in (*held.get(i, ()), 0)]
    columns = lambda rows, names, kinds: pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    lists = pa.list_(pa.int64())
    found = soft._block_consistency(columns(arcs, ["source", "targets", "values"], [pa.int64(), lists, lists]), columns(mine, ["source", "target", "others"], [pa.int64(), pa.int64(), lists]))
    want = [sum(p for s in near[0][i] if s in held for t, p in held[s].items() if t in near[1][j]) / 1e12 for i, j, _ in mine]
    assert found.column("consistency").to_pylist() == want and any(want)


@pytest.mark.parametrize("most", [3, 1000])
def test_greedy_in_rounds_and_in_sequence(spark, monkeypatch, most):
    """Equal values make a chain: each pair is free only when the one before is settled."""
    monkeypatch.setattr(soft, "SEQUENCE", most)
    rows = [(i, j, 0.5) for i in range(6) for j in (i, i + 1)]
    found = soft.greedy(spark.createDataFrame(rows, "source long, target long, similarity double"))
    assert sorted((r.source, r.target) for r in found.collect()) == [(i, i) for i in range(6)]


def test_triangles_have_a_row_an_edge_and_none_a_wedge(spark, monkeypatch):
    """A wheel: its hub has 300 * 299 / 2 wedges; what is written are the edges and a list a vertex."""
    sizes = {}

    def spied(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(features, "written", spied)
    rim = [(i, i % 300 + 1) for i in range(1, 301)]
    edges = graphs.clean_edges(spark.createDataFrame([*rim, *((0, i) for i in range(1, 301))], "u long, v long"))
    found = {r.v: r.triangles for r in features.triangles(graphs.Graph(spark.range(301).withColumnRenamed("id", "v"), edges)).collect()}
    assert found == {0: 300} | {i: 2 for i in range(1, 301)}
    assert sizes["ends"] == 600 and sizes["lists"] <= 300


def test_triangles_equal_brute_force(spark):
    r = random.Random(5)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(200)}
    graph = graphs.Graph(spark.range(45).withColumnRenamed("id", "v"), spark.createDataFrame(sorted(pairs), "u long, v long"))
    want = [sum({(a, b), (a, c), (b, c)} <= pairs for a, b, c in itertools.combinations(range(40), 3) if v in (a, b, c)) for v in range(45)]
    assert [x.triangles for x in features.structural(graph).orderBy("v").collect()] == want


def test_large_blocks_of_targets():
    """1.2 million different targets are two blocks, not ten, and leaves that can't hold a best are not looked at."""
    assert candidates.strategy(1_200_000, 1_200_000, 10, False).startswith("exhaustive, 10 x 2 blocks")
    x = np.random.default_rng(7).normal(size=(20_000, 6))
    frame = pd.DataFrame(x, columns=list(FEATURES))
    found = candidates._block_top(frame.iloc[:100].assign(source=np.arange(100)), frame.assign(targets=[np.array([i]) for i in range(20_000)]), 1, [(f, 1.0) for f in FEATURES], 0.0)
    assert found.sort_values("source")["target"].tolist() == list(range(100))
