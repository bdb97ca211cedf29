"""Matching and components of one task, of many tasks and in rounds give the same, and long chains take no rounds."""

import random

import pytest
from vertexloom.operators import assign
from vertexloom.tables import written


@pytest.fixture
def writes(monkeypatch):
    """Names of tables that assign.py writes."""
    names = []
    monkeypatch.setattr(assign, "written", lambda df, name: (names.append(name), written(df, name))[1])
    return names


def _pairs(spark):
    r = random.Random(5)
    rows = {(s, t) for s in range(60) for t in (s // 2 + r.randrange(-2, 3), s + r.randrange(3)) if 0 <= t < 60}
    return spark.createDataFrame(sorted(rows) + sorted(rows)[:5], "source long, target long")


def test_matching_looks_for_no_components_of_few_pairs(spark, writes, rows_of, monkeypatch):
    found = rows_of(assign.matching(_pairs(spark), 62, 60))
    assert writes == []
    mates = [t for _, _, t in found if t is not None]  # columns in order of names: conflict, source, target
    assert len(mates) == len(set(mates)) and {(61, True), (60, True)} <= {(s, c) for c, s, _ in found}
    monkeypatch.setattr(assign, "PAIRS", 0)
    parts = rows_of(assign.matching(_pairs(spark), 62, 60))
    assert [(c, s) for c, s, _ in parts] == [(c, s) for c, s, _ in found] and len(mates) == sum(t is not None for _, _, t in parts)


def test_components_of_a_chain_take_no_rounds(spark, writes, rows_of, monkeypatch):
    """A chain of 300 nodes whose numbers jump, and two nodes alone; the same thinned by tasks and in rounds."""
    chain = [i * 77 % 300 for i in range(300)]
    edges, nodes = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long"), spark.range(302).withColumnRenamed("id", "node")
    want = rows_of(assign.connected(edges, nodes))
    assert writes == ["links", "labels"] and [c for c, _ in want] == [0] * 300 + [300, 301]
    for links in (250, 10):
        monkeypatch.setattr(assign, "LINKS", links)
        assert rows_of(assign.connected(edges, nodes)) == want
    doubled = edges.unionByName(edges).unionByName(edges).unionByName(edges).coalesce(1)
    monkeypatch.setattr(assign, "LINKS", 600)
    writes.clear()
    assert rows_of(assign.connected(doubled, nodes)) == want and writes[:2] == ["links", "links"]


def test_support_repair_makes_one_list_and_equals_searches_for_conflicts(spark, monkeypatch):
    from conftest import SF
    from pyspark.sql import functions as F
    from vertexloom import suite
    from vertexloom.operators import candidates, support

    made, search = [], candidates.exhaustive
    monkeypatch.setattr(candidates, "exhaustive", lambda a, b, k, **options: (made.append(k), search(a, b, k, **options))[1])
    monkeypatch.setattr(suite, "_HELD", {key: held for key, held in suite._HELD.items() if not key[2].startswith("top-")})
    found = [tuple(r) for r in suite.support_repair(spark, SF).orderBy("round").collect()]
    assert made == [16]
    _, _, _, n, _, _, za, zb = suite._z(spark, SF)
    prefix = lambda s, k: search(za.join(s.select(F.col("source").alias("v")), "v", "left_semi"), zb, k)
    _, why, history = support.repair(written(search(za, zb, 2), "start"), n, n, 2, prefix, 16)
    assert found == [(i, h["k"], h["matching"], h["edges"], why) for i, h in enumerate(history)]
