"""The soft matching's shortcuts give what the longer ways give."""

import random

import pytest
from vertexloom.operators import soft
from vertexloom.operators.assign import solve
from vertexloom.operators.graph import Graph
from vertexloom.tables import written


@pytest.fixture
def writes(monkeypatch):
    """Names of tables that soft.py writes."""
    names = []
    monkeypatch.setattr(soft, "written", lambda df, name: (names.append(name), written(df, name))[1])
    return names


def _rows(seed, n, m, share):
    r = random.Random(seed)
    return [(s, t, round(r.random(), 3)) for s in range(n) for t in range(m) if r.random() < share]


def _table(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, similarity double")


@pytest.mark.parametrize("last", ["target", "source"])
def test_scaled_by_one_task_as_by_windows(spark, writes, monkeypatch, last):
    table = _table(spark, [*_rows(1, 9, 7, 0.5), (20, 3, -90.0)])
    key = lambda df: {(x.source, x.target): x.probability for x in df.collect()}
    one = key(soft.scaled_rounds(table, 3, 0.1, last)[0])
    assert writes == ["scaled"]
    monkeypatch.setattr(soft, "PAIRS", 0)
    assert one == pytest.approx(key(soft.scaled_rounds(table, 3, 0.1, last)[0]), abs=1e-12)


def test_links_are_made_once_and_sum_as_consistency(spark, writes):
    r = random.Random(4)
    sides = [[(u, v) for u in range(14) for v in range(u + 1, 14) if r.random() < 0.4] for _ in "ab"]
    one, two = (Graph(spark.range(15).withColumnRenamed("id", "v"), spark.createDataFrame(e, "u long, v long")) for e in sides)
    table = _table(spark, _rows(2, 15, 15, 0.3))
    shares = table.withColumnRenamed("similarity", "probability")
    want = {(x.source, x.target): x.consistency for x in soft.consistency(shares, one, two).collect() if x.consistency}
    assert want and {(x.source, x.target): x.consistency for x in soft.linked_consistency(shares, soft.links(table, one, two)).collect()} == want
    soft.soft_match(one, two, table, 2, 2).count()
    assert writes.count("linked") == 1 and writes.count("scaled") == writes.count("consistency") == 2


def test_reduced_assignment_needs_no_dear_places(spark, writes, monkeypatch):
    """More sources than their targets in one part, more targets in another: as many pairs, and as good, as with a dear place for each source."""
    costs, seen = [], soft.assignment
    monkeypatch.setattr(soft, "assignment", lambda table, n, m: (costs.extend(x.cost for x in table.collect()), seen(table, n, m))[1])
    rows = [*_rows(6, 9, 5, 0.5), *[(s + 8, t + 4, v) for s, t, v in _rows(7, 6, 9, 0.4)]]
    score = {(s, t): v for s, t, v in rows}
    dear = {}
    for (s, t), v in score.items():
        dear.setdefault(s, [(100 + s, 1e6)]).append((t, -v))
    mates = {s: t for s, t in solve(dear)[0].items() if t < 100}
    rows = [(s, t, v) for (s, t), v in score.items()]
    empty = _table(spark, []).withColumnRenamed("similarity", "value")
    found = [(x.source, x.target) for x in soft.reduced_assignment(_table(spark, rows), empty, 0.5).collect()]
    assert len(found) == len(mates) == len({s for s, _ in found}) == len({t for _, t in found}) < len(dear)
    assert sum(score[p] for p in found) == pytest.approx(sum(score[p] for p in mates.items())) and max(costs) <= 0
