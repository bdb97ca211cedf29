"""Small named graphs of the social-network literature. Larger ones are read from files with files.read_edge_list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexloom.operators.graph import Graph, paired

# The published graphs. Each member's neighbours of higher number (Zachary, 1977).
KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32), 3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,),
    8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33), 18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,),
    26: (29, 33), 27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}
# Marriages of families (Padgett).
FLORENTINE = {
    "Acciaiuoli": "Medici", "Castellani": "Peruzzi Strozzi Barbadori", "Medici": "Barbadori Ridolfi Tornabuoni Albizzi Salviati", "Salviati": "Pazzi", "Peruzzi": "Strozzi Bischeri",
    "Strozzi": "Ridolfi Bischeri", "Ridolfi": "Tornabuoni", "Tornabuoni": "Guadagni", "Albizzi": "Ginori Guadagni", "Bischeri": "Guadagni", "Guadagni": "Lamberteschi",
}
# Events that each woman went to (Davis, 1941).
DAVIS = (
    (1, 2, 3, 4, 5, 6, 8, 9), (1, 2, 3, 5, 6, 7, 8), (2, 3, 4, 5, 6, 7, 8, 9), (1, 3, 4, 5, 6, 7, 8), (3, 4, 5, 7), (3, 5, 6, 8), (5, 6, 7, 8), (6, 8, 9), (5, 7, 8, 9), (7, 8, 9, 12),
    (8, 9, 10, 12), (8, 9, 10, 12, 13, 14), (7, 8, 9, 10, 12, 13, 14), (6, 7, 9, 10, 11, 12, 13, 14), (7, 8, 10, 11, 12), (8, 9), (9, 11), (9, 11),
)

NAMES = ("karate", "florentine", "davis")


def _pairs(name: str) -> list[tuple[int, int]]:
    if name == "karate":
        return [(u, v) for u, more in KARATE.items() for v in more]
    if name == "florentine":
        rows = [(a, b) for a, more in FLORENTINE.items() for b in more.split()]
        place = {x: i for i, x in enumerate(sorted({x for row in rows for x in row}))}
        return [tuple(sorted((place[a], place[b]))) for a, b in rows]
    if name == "davis":
        return [(i, len(DAVIS) + e - 1) for i, events in enumerate(DAVIS) for e in events]
    raise ValueError(f"no graph is named {name}; there are {', '.join(NAMES)}")


def named_graph(spark: SparkSession, name: str) -> Graph:
    pairs = _pairs(name)
    vertices = spark.range(1 + max(v for _, v in pairs)).withColumnRenamed("id", "v")
    return Graph(vertices, spark.createDataFrame(pairs, "u long, v long"))


def named_pair(spark: SparkSession, name: str, noise: float = 0.05, seed: int = 42) -> tuple[Graph, Graph, DataFrame]:
    """A named graph, its noisy permuted copy and the true mapping."""
    one = named_graph(spark, name)
    two, truth = paired(one, noise, seed)
    return one, two, truth
