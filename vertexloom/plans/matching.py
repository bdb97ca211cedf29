"""The whole matching: features, candidates, support, assignment, confidences, measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.scores import FEATURES
from vertexloom.operators import assign, candidates, features, soft, support
from vertexloom.operators.costs import costs
from vertexloom.operators.graph import Graph
from vertexloom.tables import written


@dataclass(frozen=True)
class MatchConfig:
    k: int = 20
    normalisation: str = "joint"
    mask: tuple[str, ...] = FEATURES
    weights: dict[str, float] | None = None
    profile_weight: float = 0.0
    bins: int = 16
    index: candidates.IndexConfig | None = None
    repair: bool = False
    k_limit: int | None = None
    confidences: bool = False


@dataclass(frozen=True)
class SoftConfig:
    """Settings of the soft matching."""

    k: int = 32
    scaling: int = 50
    rounds: int = 5
    epsilon: float = 0.05
    tau: float = 0.5


#: Settings for an answer at once, soon, and as good as can be.
PRESETS = {
    "realtime": SoftConfig(k=8, scaling=10, rounds=1, epsilon=0.1, tau=0.3),
    "interactive": SoftConfig(k=16, scaling=20, rounds=2, epsilon=0.08),
    "batch": SoftConfig(k=32, scaling=50, rounds=5),
}


@dataclass
class MatchResult:
    candidates: DataFrame
    assignment: DataFrame | None
    certificate: DataFrame | None
    confidences: DataFrame | None
    status: str
    notes: dict = field(default_factory=dict)


@dataclass
class Prepared:
    """A graph's raw features and profiles, written, to match many others against."""

    graph: Graph
    raw: DataFrame
    profile: DataFrame


def prepare(graph: Graph, bins: int = 16) -> Prepared:
    return Prepared(graph, written(features.structural(graph), "features"), written(features.profiles(graph, bins), "profiles"))


def find_candidates(one: Prepared, two: Prepared, config: MatchConfig) -> DataFrame:
    a, b = features.normalised_pair(one.raw, two.raw, config.normalisation)
    if config.index is not None:
        return candidates.indexed(a, b, one.raw, two.raw, config.k, config.index, config.mask, config.weights)
    if config.profile_weight:
        a, b = a.join(one.profile, "v"), b.join(two.profile, "v")
    return candidates.exhaustive(a, b, config.k, config.mask, config.weights, config.profile_weight, config.bins)


def match_softly(one: Prepared, two: Prepared, mode: str | SoftConfig = "batch") -> DataFrame:
    """source, target by the soft matching with a preset or settings of one's own."""
    config = PRESETS[mode] if isinstance(mode, str) else mode
    found = written(find_candidates(one, two, MatchConfig(k=min(config.k, two.graph.vertices.count()))), "candidates")
    return soft.soft_match(one.graph, two.graph, found, config.rounds, config.scaling, config.tau, config.epsilon)


def match(one: Prepared, two: Prepared, config: MatchConfig = MatchConfig()) -> MatchResult:
    """Vertices of both graphs are dense from 0. Status: optimal, or infeasible where the support has no complete assignment."""
    n, m = one.graph.vertices.count(), two.graph.vertices.count()
    found = written(find_candidates(one, two, config), "candidates")
    notes: dict = {"strategy": candidates.strategy(n, m, config.k, config.index is not None)}
    if config.repair:
        a, b = features.normalised_pair(one.raw, two.raw, config.normalisation)
        a, b = written(a, "z-source"), written(b, "z-target")

        def prefix(sources: DataFrame, k: int) -> DataFrame:
            return candidates.exhaustive(a.join(sources.select(F.col("source").alias("v")), "v", "left_semi"), b, k, config.mask, config.weights)

        found, notes["repair"], notes["history"] = support.repair(found, n, m, config.k, prefix, config.k_limit)
    table = written(costs(found), "costs")
    size = assign.matching(table, n, m).where("target is not null").count()
    notes["matching"] = size
    if size < n:
        return MatchResult(found, None, None, None, "infeasible", notes)
    assigned = assign.assignment(table, n, m)
    proof = assign.certificate(table, assigned)
    shares = None
    if config.confidences:
        shares, notes["scaling"] = soft.sinkhorn(table) if n == m else (None, {"status": "skipped_rectangular"})
    return MatchResult(found, assigned, proof, shares, "optimal" if proof.first().optimal else "failed", notes)
