"""Files: graphs, edge lists, candidates, mappings, metrics. Schemas are fixed, never inferred."""

from __future__ import annotations

import contextlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.assign import connected
from vertexloom.operators.graph import Graph, build, clean_edges, relabelled, variants

CANDIDATES = "source long, rank int, target long, similarity double"
ASSIGNMENT = "source long, target long, cost double"
MATCHING = "source long, target long"
CONFIDENCE = "source long, target long, probability double"
TRUTH = "source_vertex long, target_vertex long"
COVERAGE = "target long, incoming_candidate_count long"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, at of the lines that aren't blank or comments, in file order."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return rows.select(F.trim("value").alias("line"), "at").where(F.col("line").rlike("^[^#%]"))


def read_graph(spark: SparkSession, path: str, check_edges: bool = True) -> Graph:
    """The native format: a header "n m", then an edge a line; # and % start comments. Lines that are no edge are skipped.

    check_edges: whether m must be the number of edges.
    """
    lines = _numbered_lines(spark, path)
    head = lines.orderBy("at").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    n, m = (int(x) for x in head.line.split()[:2])
    rows = lines.where(F.col("at") != head.at).select(F.expr("try_cast(get(split(line, '\\\\s+'), 0) as long)").alias("u"), F.expr("try_cast(get(split(line, '\\\\s+'), 1) as long)").alias("v"))
    edges = rows.where("u is not null and v is not null")
    if check_edges and (found := edges.count()) != m:
        raise ValueError(f"{path} names {m} edges and has {found}")
    return build(spark.range(n).withColumnRenamed("id", "v"), edges)


def write_graph(graph: Graph, path: str) -> None:
    """The native format, in one file: edges ascending."""
    n, m = graph.vertices.count(), graph.edges.count()
    head = graph.edges.sparkSession.createDataFrame([(-1, -1, f"{n} {m}")], "u long, v long, value string")
    rows = graph.edges.select("u", "v", F.concat_ws(" ", "u", "v").alias("value")).unionByName(head)
    rows.orderBy("u", "v").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Any pairs of ids, gzip too: cleaned and relabelled from 0; and mapping (original, v)."""
    rows = _numbered_lines(spark, path).select(F.expr("try_cast(get(split(line, '[\\\\s,]+'), 0) as long)").alias("u"), F.expr("try_cast(get(split(line, '[\\\\s,]+'), 1) as long)").alias("v"))
    return relabelled(clean_edges(rows))


def largest_component(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph on its largest connected component (of equals the one with the smallest vertex), relabelled from 0; and mapping (original, v)."""
    parts = connected(graph.edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    best = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").first()
    inside = parts.where(F.col("component") == (best.component if best else -1)).select(F.col("node").alias("u"))
    return relabelled(graph.edges.join(inside, "u", "left_semi"))


def convert(spark: SparkSession, edge_list: str, path: str) -> None:
    write_graph(read_edge_list(spark, edge_list)[0], path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_candidates(spark: SparkSession, path: str, n_sources: int, n_targets: int) -> DataFrame:
    """Four columns, or three without rank; raises on repeated, unknown or infinite entries."""
    width = len(spark.read.option("header", True).csv(path).columns)
    rows = read_csv(spark, path, CANDIDATES if width > 3 else "source long, target long, similarity double")
    bad = rows.agg(F.count_if(F.col("similarity").isNull() | F.isnan("similarity") | (F.abs("similarity") == float("inf"))).alias("x"), F.count_if(~(F.col("source").between(0, n_sources - 1) & F.col("target").between(0, n_targets - 1))).alias("y")).first()
    repeated = rows.groupBy("source", "target").count().where("count > 1").take(1)
    if bad.x or bad.y or repeated:
        raise ValueError(f"{bad.x} infinite scores, {bad.y} unknown ids" + ", repeated pairs" * bool(repeated))
    return rows


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a truth file; raises if a source stands twice."""
    rows = read_csv(spark, path, TRUTH).select(F.col("source_vertex").alias("source"), F.col("target_vertex").alias("target"))
    if rows.groupBy("source").count().where("count > 1").take(1):
        raise ValueError(f"{path} names a source twice")
    return rows


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_assignment(assigned: DataFrame, path: str) -> None:
    """Unmatched sources have target -1 and cost -1."""
    write_csv(assigned.select("source", F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("cost", F.lit(-1.0)).alias("cost")), path, "source")


def write_matching(found: DataFrame, path: str) -> None:
    """Unmatched sources have target -1."""
    write_csv(found.select("source", F.coalesce("target", F.lit(-1)).alias("target")), path, "source")


def write_candidates(candidates: DataFrame, path: str) -> None:
    write_csv(candidates.select("source", "rank", "target", "similarity"), path, "source", "rank")


def write_costs(costs: DataFrame, path: str) -> None:
    """Rows in order of source and target: a sparse matrix by rows."""
    write_csv(costs.select("source", "target", "cost"), path, "source", "target")


def write_confidences(shares: DataFrame, path: str) -> None:
    write_csv(shares.select("source", "target", "probability"), path, "source", "target")


def metrics_json(metrics: dict) -> str:
    """One document; what wasn't measured is null, not zero."""
    return json.dumps(metrics, sort_keys=True, indent=2)


class Stages:
    """Seconds and counts of the stages of a run, for one document."""

    def __init__(self):
        self.stages: list[dict] = []

    @contextlib.contextmanager
    def stage(self, name: str, **counts):
        began = time.perf_counter()
        row = {"stage": name, "seconds": None, **counts}
        self.stages.append(row)
        yield row
        row["seconds"] = round(time.perf_counter() - began, 6)

    def document(self, **more) -> str:
        """A stage that failed has null seconds; total counts the others."""
        return metrics_json({"stages": self.stages, "total_seconds": round(sum(s["seconds"] or 0.0 for s in self.stages), 6), **more})


def read_support(spark: SparkSession, path: str, n_sources: int, n_targets: int) -> DataFrame:
    """source, target of a candidates file, checked like read_candidates."""
    return read_candidates(spark, path, n_sources, n_targets).select("source", "target")


def write_pairs(graph: Graph, mapping: DataFrame, folder: str, label: str, noises: tuple[float, ...] = (0.0,), seeds: tuple[int, ...] = (11, 22, 33)) -> dict:
    """A cleaned graph, its id mapping and its shuffled copies with their truths, in folders by seed and noise; and the manifest that is written beside them."""
    spark = graph.edges.sparkSession
    write_graph(graph, f"{folder}/G.graph")
    write_csv(mapping.select(F.col("original").alias("original_file_id"), F.col("v").alias("internal_id")), f"{folder}/original_id_mapping.csv", "internal_id")
    rows = []
    for (seed, noise), (target, truth) in variants(graph, noises, seeds).items():
        at = f"seed_{seed}/noise_{round(100 * noise):02d}"
        write_graph(target, f"{folder}/{at}/target.graph")
        write_csv(truth.select(F.col("source").alias("source_vertex"), F.col("target").alias("target_vertex")), f"{folder}/{at}/ground_truth.csv", "source_vertex")
        rows.append({"folder": at, "seed": seed, "edge_noise": noise, "target_edges": target.edges.count(), "matcher_inputs": ["G.graph", f"{at}/target.graph"], "evaluation_only": [f"{at}/ground_truth.csv"]})
    manifest = {"dataset": label, "num_vertices": graph.vertices.count(), "num_undirected_edges": graph.edges.count(), "cleaning": "no self-loops, distinct undirected edges", "internal_id_order": "ascending original id", "pairs": rows}
    spark.createDataFrame([(metrics_json(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def registry(spark: SparkSession) -> DataFrame:
    """Public data sets by id, with their sizes; nothing is downloaded."""
    # Names and published sizes of the SNAP collection's graphs, and Graph500 scales with 16 edges a vertex.
    rows = [
        ("G1", "ca-GrQc", "collaboration", "undirected", 5242, 14496),
        ("G2", "email-Enron", "communication", "undirected", 36692, 183831),
        ("G3", "com-DBLP", "collaboration", "undirected", 317080, 1049866),
        ("G4", "com-Amazon", "product", "undirected", 334863, 925872),
        ("G5", "web-Google", "web", "directed", 875713, 5105039),
        ("G6", "com-Youtube", "social", "undirected", 1134890, 2987624),
        ("G7", "roadNet-CA", "infrastructure", "undirected", 1965206, 2766607),
        ("G8", "soc-Pokec", "social", "directed", 1632803, 30622564),
        ("G9", "as-Skitter", "internet", "undirected", 1696415, 11095298),
        ("G10", "com-LiveJournal", "social", "undirected", 3997962, 34681189),
        ("G11", "com-Orkut", "social", "undirected", 3072441, 117185083),
        ("G12", "com-Friendster", "social", "undirected", 65608366, 1806067135),
    ]
    rows += [(f"G{i}", f"Graph500 Scale {scale}", "synthetic", "undirected", 1 << scale, 16 << scale) for i, scale in ((13, 20), (14, 24), (15, 26))]
    return spark.createDataFrame(rows, "id string, name string, category string, nature string, vertices long, edges long")
