"""Column expressions: similarities, costs, quantisation, rounding that is the same in every engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ("degree", "clustering", "avg_nd", "nd_std", "triangles", "degree_sq")
#: Below this a norm or a deviation counts as zero.
EPSILON = 1e-12


def checked_weights(mask: tuple[str, ...] = FEATURES, weights: dict[str, float] | None = None) -> list[tuple[str, float]]:
    if unknown := set(mask) - set(FEATURES) | set(weights or {}) - set(FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    if any(w < 0 or not math.isfinite(w) for w in (weights or {}).values()):
        raise ValueError("weights must be finite and not negative")
    return [(f, (weights or {}).get(f, 1.0)) for f in FEATURES if f in mask]


def dot(a: str, b: str, terms: list[tuple[str, float]]) -> Column:
    """The weighted product of the features with prefixes a and b, summed from the left."""
    out = F.lit(0.0)
    for f, w in terms:
        out = out + F.col(f"{a}{f}") * F.col(f"{b}{f}") * F.lit(float(w))
    return out


def norm(prefix: str, terms: list[tuple[str, float]]) -> Column:
    return F.sqrt(dot(prefix, prefix, terms))


def cosine(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a norm is zero; raises on values that aren't finite."""
    size = norm_a * norm_b
    value = F.when(size < EPSILON, 0.0).otherwise(product / F.when(size < EPSILON, 1.0).otherwise(size))
    finite = F.when(F.isnan(value), F.raise_error(F.lit("similarity isn't finite")).cast("double")).otherwise(value)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), finite))


def cost(similarity: Column) -> Column:
    return 1 - similarity


def rank_key(score: Column) -> Column:
    """What scores are ranked by: noise of the last bits can't reorder ties."""
    return F.round(score, 9)


def quantised(value: Column, width: float) -> Column:
    """floor(log1p(value) / width) of a value that isn't negative."""
    if not (width > 0 and math.isfinite(width)):
        raise ValueError("width must be finite and positive")
    bad = value.isNull() | F.isnan(value) | (value < 0)
    return F.when(bad, F.raise_error(F.lit("a value to quantise is negative or not finite")).cast("long")).otherwise(F.floor(F.log(1 + value) / F.lit(float(width))).cast("long"))


def draw(*parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 that looks random and depends on parts only: the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[x.cast("string") for x in parts])), 1, 8), 16, 10).cast("long")
