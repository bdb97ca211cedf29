"""Matching graphs that arrive on a stream against one that was prepared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.operators.graph import Graph, clean_edges
from vertexloom.plans.matching import MatchConfig, Prepared, find_candidates, prepare


def match_arriving(edges: DataFrame, prepared: Prepared, n: int, out: Callable[[DataFrame, int], None], checkpoint: str, config: MatchConfig = MatchConfig()) -> StreamingQuery:
    """Each batch of a stream of edges (u, v) is a graph of n vertices; out gets its candidates (source in the arriving graph) and the batch's number."""
    spark = edges.sparkSession

    def each(rows: DataFrame, batch: int) -> None:
        graph = Graph(spark.range(n).withColumnRenamed("id", "v"), clean_edges(rows))
        out(find_candidates(prepare(graph, config.bins), prepared, config).withColumn("batch", F.lit(batch)), batch)

    return edges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
