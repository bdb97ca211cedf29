"""Graphs as tables: vertices (v) and canonical edges (u, v) with u < v."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.scores import draw
from vertexloom.tables import written


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # v
    edges: DataFrame  # u < v, distinct

    @property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge."""
        return self.edges.unionByName(self.edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def clean_edges(raw: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Canonical distinct edges without self-loops from any pairs."""
    pairs = raw.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return pairs.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).distinct()


def relabelled(edges: DataFrame) -> tuple[Graph, DataFrame]:
    """A graph of dense ids from 0, ascending by original id, and mapping (original, v). Vertices come from edges only.

    Ids are range-partitioned and counted per partition; only the counts meet in one window.
    """
    ids = edges.select(F.col("u").alias("original")).union(edges.select("v")).distinct()
    rows = written(ids.repartitionByRange("original").sortWithinPartitions("original").withColumn("at", F.monotonically_increasing_id()), "ids")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    mapping = rows.join(parts, "part").select("original", (F.col("before") + F.col("at") - F.col("first")).alias("v"))
    return Graph(mapping.select("v"), mapped_edges(edges, mapping.select(F.col("original").alias("source"), F.col("v").alias("target")))), mapping


def mapped_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges under mapping (source, target)."""
    one = mapping.select(F.col("source").alias("u"), F.col("target").alias("mu"))
    two = mapping.select(F.col("source").alias("v"), F.col("target").alias("mv"))
    return edges.join(one, "u").join(two, "v").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))


def permuted(graph: Graph, mapping: DataFrame) -> Graph:
    return Graph(mapping.select(F.col("target").alias("v")), mapped_edges(graph.edges, mapping))


def violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: n_vertices, n_edges, self_loops, not_canonical, repeated, out_of_range."""
    sums = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    inner = sums.join(vertices.select(F.col("v").alias("u"), F.lit(1).alias("has_u")), "u", "left").join(vertices.select("v", F.lit(1).alias("has_v")), "v", "left")
    counts = inner.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.count_if(F.col("u") == F.col("v")).alias("self_loops"),
        F.count_if(F.col("u") > F.col("v")).alias("not_canonical"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        F.count_if(F.col("has_u").isNull() | F.col("has_v").isNull()).alias("out_of_range"),
    )
    return vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(counts))  # one row each


def build(vertices: DataFrame, edges: DataFrame) -> Graph:
    """A graph of canonical edges; raises on an empty graph, self-loops, repeated edges or ids that are no vertex."""
    canonical = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    row = violations(vertices, canonical).first()
    if not row.n_vertices:
        raise ValueError("a graph needs a vertex")
    for what in ("self_loops", "repeated", "out_of_range"):
        if row[what]:
            raise ValueError(f"{row[what]} edges: {what}")
    return Graph(vertices, canonical)


def degrees(graph: Graph) -> DataFrame:
    counts = graph.adjacency.groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "v")
    return graph.vertices.join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbors(graph: Graph) -> DataFrame:
    return graph.adjacency.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbors")).withColumnRenamed("u", "v")


def has_edges(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with present: whether the graph has the edge, in either direction; false for what is no vertex."""
    keys = pairs.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    return keys.join(graph.edges.withColumn("has", F.lit(True)), ["u", "v"], "left").select("a", "b", F.coalesce("has", F.lit(False)).alias("present"))


def noisy(graph: Graph, removed: Column) -> Graph:
    """The graph without edges where removed (of u, v) holds."""
    return Graph(graph.vertices, graph.edges.where(~removed))


def flipped(graph: Graph, pairs: DataFrame) -> Graph:
    """Each pair (a, b), as often as it stands, toggles its edge."""
    odd = clean_pairs(pairs).groupBy("u", "v").agg(F.count("*").alias("n")).where("n % 2 = 1").select("u", "v")
    return Graph(graph.vertices, graph.edges.join(odd, ["u", "v"], "left_anti").unionByName(odd.join(graph.edges, ["u", "v"], "left_anti")))


def clean_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def paired(graph: Graph, noise: float, seed: int) -> tuple[Graph, DataFrame]:
    """A shuffled, noisy copy and its truth (source, target): noise of the edges go, as many edges that weren't there come.

    Order is by a hash of seed and id, so reruns agree; vertices must be dense from 0. A graph with
    fewer free pairs than that gets all of them.
    """
    n, m = graph.vertices.count(), graph.edges.count()
    _, truth = relabelled_by(graph.vertices.select(F.col("v").alias("source")), draw(F.lit(seed), F.col("source")), "source")
    drop = int(m * noise)
    _, ranks = relabelled_by(graph.edges, draw(F.lit(seed + 1), F.col("u"), F.col("v")), "u", "v")
    kept = ranks.where(F.col("target") >= drop).select("u", "v")
    fresh = _first_edges(graph.edges.sparkSession, n, min(drop, n * (n - 1) // 2 - m), seed + 2, graph.edges)
    return Graph(graph.vertices, mapped_edges(written(kept.unionByName(fresh), "noisy"), truth)), truth


def variants(graph: Graph, noises: tuple[float, ...], seeds: tuple[int, ...] = (11, 22, 33)) -> dict[tuple[int, float], tuple[Graph, DataFrame]]:
    """paired() for every seed and noise."""
    if any(not 0 <= x <= 1 for x in noises):
        raise ValueError("noise must be between 0 and 1")
    return {(seed, noise): paired(graph, noise, seed) for noise in noises for seed in seeds}


def _first_edges(spark: SparkSession, n: int, m: int, seed: int, without: DataFrame | None = None) -> DataFrame:
    """The first m distinct edges of an endless row of random pairs, but for those of without; more are drawn until they suffice."""
    factor = 4
    while True:
        ids = spark.range(factor * m + 16)
        pairs = ids.select("id", (draw(F.lit(seed), F.col("id")) % n).alias("a"), (draw(F.lit(seed + 1), F.col("id")) % n).alias("b"))
        found = clean_pairs_with_id(pairs)
        found = found if without is None else found.join(without, ["u", "v"], "left_anti")
        found = written(found, "drawn")
        if m <= 0 or found.count() >= m:
            return _first(found, m)
        factor *= 4


def _first(found: DataFrame, m: int) -> DataFrame:
    """The m rows (u, v, id) of smallest id."""
    _, ranks = relabelled_by(found, F.col("id"), "u", "v")
    return ranks.where(F.col("target") < m).select("u", "v")


def relabelled_by(rows: DataFrame, key: Column, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows, and rows with target: their place in the order of key, then columns."""
    ordered = rows.withColumn("key", key).repartitionByRange("key", *columns).sortWithinPartitions("key", *columns)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "order").withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows, ordered.join(parts, "part").select(*columns, (F.col("before") + F.col("at") - F.col("first")).alias("target"))


def toy_pair(spark: SparkSession) -> tuple[Graph, Graph, DataFrame]:
    """Two isomorphic graphs of six vertices and their truth."""
    # The example graphs.
    source = [(0, 1), (0, 5), (1, 2), (1, 3), (1, 4), (2, 3), (2, 5), (3, 4)]
    target = [(3, 0), (3, 2), (0, 5), (0, 1), (0, 4), (5, 1), (5, 2), (1, 4)]
    truth = [3, 0, 5, 1, 4, 2]
    vertices = spark.range(6).withColumnRenamed("id", "v")
    one, two = (build(vertices, spark.createDataFrame(e, "u long, v long")) for e in (source, target))
    return one, two, spark.createDataFrame(list(enumerate(truth)), "source long, target long")


# ---------------------------------------------------------------- generators

def _unit(*parts: Column) -> Column:
    return draw(*parts) / 4294967296.0


def random_edges(spark: SparkSession, n: int, m: int, seed: int) -> Graph:
    """m distinct edges at random, or all that there are."""
    return Graph(spark.range(n).withColumnRenamed("id", "v"), written(_first_edges(spark, n, min(m, n * (n - 1) // 2), seed), "random"))


def clean_pairs_with_id(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "id").groupBy("u", "v").agg(F.min("id").alias("id"))


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19, most_draws: int = 64) -> Graph:
    """A Kronecker graph of 2**scale vertices and edge_factor edges a vertex: each edge chooses a quadrant at every level.

    Pairs are drawn until there are as many distinct edges, or most_draws times as many pairs, as the densest corner may run out of pairs.
    """
    m, factor = edge_factor << scale, 2
    u, v = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(scale):
        r = _unit(F.lit(seed), F.lit(level), F.col("id"))
        down, right = (r >= a + b).cast("long"), (((r >= a) & (r < a + b)) | (r >= a + b + c)).cast("long")
        u, v = u * 2 + down, v * 2 + right
    while True:
        found = written(clean_pairs_with_id(spark.range(factor * m).select(u.alias("a"), v.alias("b"), "id")), "drawn")
        if found.count() >= m or factor >= most_draws:
            return Graph(spark.range(1 << scale).withColumnRenamed("id", "v"), _first(found, m))
        factor *= 2


def block_model(spark: SparkSession, sizes: list[int], within: float, between: float, seed: int = 1) -> Graph:
    """Vertices in blocks; edges as many as expected of one chance inside a block and another across, drawn block pair by block pair, so no pair but an edge is made."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    edges = spark.createDataFrame([], "u long, v long")
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes[i:], i):
            of = seed * 1_000_003 + 2 * (i * len(sizes) + j)
            room = a * (a - 1) // 2 if i == j else a * b
            m = round(room * (within if i == j else between))
            if i == j:
                part = _first_edges(spark, a, m, of)
            else:
                part = _first_across(spark, a, b, m, of)
            edges = edges.unionByName(part.select((F.col("u") + starts[i]).alias("u"), (F.col("v") + starts[j]).alias("v")))
    return Graph(spark.range(sum(sizes)).withColumnRenamed("id", "v"), edges)


def _first_across(spark: SparkSession, a: int, b: int, m: int, seed: int) -> DataFrame:
    """The first m distinct pairs of one of a and one of b."""
    factor = 4
    while True:
        pairs = spark.range(factor * m + 16).select("id", (draw(F.lit(seed), F.col("id")) % a).alias("u"), (draw(F.lit(seed + 1), F.col("id")) % b).alias("v"))
        found = written(pairs.groupBy("u", "v").agg(F.min("id").alias("id")), "drawn")
        if found.count() >= m:
            return _first(found, m)
        factor *= 4


def preferential(spark: SparkSession, n: int, m: int, seed: int = 1) -> Graph:
    """Each new vertex joins m others, chosen by degree. Sequential by nature: made in the driver."""
    r, ends, edges = random.Random(seed), list(range(m)), set()
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < min(m, v):
            chosen.add(r.choice(ends))
        edges |= {(u, v) for u in chosen}
        ends += [*chosen, *[v] * len(chosen)]
    return Graph(spark.range(n).withColumnRenamed("id", "v"), spark.createDataFrame(sorted(edges), "u long, v long"))


def small_world(spark: SparkSession, n: int, k: int, chance: float, seed: int = 1) -> Graph:
    """A ring where each vertex joins its k nearest; each edge's far end moves with a chance. Made in the driver."""
    r, edges = random.Random(seed), {(min(v, (v + d) % n), max(v, (v + d) % n)) for v in range(n) for d in range(1, k // 2 + 1)}
    for u, v in sorted(edges):
        if r.random() < chance:
            w = r.randrange(n)
            if w != u and (min(u, w), max(u, w)) not in edges:
                edges.remove((u, v))
                edges.add((min(u, w), max(u, w)))
    return Graph(spark.range(n).withColumnRenamed("id", "v"), spark.createDataFrame(sorted(edges), "u long, v long"))


def within_reach(graph: Graph, start: int, most: int) -> Graph:
    """The graph on the first vertices that a breadth-first search from start meets, whole layers until there are most of them."""
    seen = written(graph.vertices.where(F.col("v") == start), "seen")
    arcs, size = written(graph.adjacency, "arcs"), 1
    while size < most:
        fresh = arcs.join(seen.withColumnRenamed("v", "u"), "u", "left_semi").select("v").distinct().join(seen, "v", "left_anti")
        grown = written(seen.unionByName(fresh), "seen")
        if (now := grown.count()) == size:
            break
        seen, size = grown, now
    inner = graph.edges.join(seen.withColumnRenamed("v", "u"), "u", "left_semi").join(seen, "v", "left_semi").select("u", "v")
    return Graph(seen, inner)


def grid(spark: SparkSession, rows: int, columns: int) -> Graph:
    ids = spark.range(rows * columns).withColumnRenamed("id", "u")
    right = ids.where(F.col("u") % columns < columns - 1).select("u", (F.col("u") + 1).alias("v"))
    down = ids.where(F.col("u") < (rows - 1) * columns).select("u", (F.col("u") + columns).alias("v"))
    return Graph(ids.withColumnRenamed("u", "v"), right.unionByName(down))
