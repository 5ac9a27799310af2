"""Scores on absolute scales from 0 to 1."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default weights of the retrieval components.
WEIGHTS = {"exact": 0.30, "lexical": 0.25, "fuzzy": 0.20, "semantic": 0.15, "hierarchy": 0.05, "index_term": 0.05}
COVERAGE_WEIGHT = 0.75
FUZZY_THRESHOLD = 0.3
PER_METHOD = 30


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def lexical_score(coverage: Column, density: Column) -> Column:
    """Three parts coverage, one part density, to four places."""
    return F.round(clamp(coverage) * COVERAGE_WEIGHT + clamp(density) * (1 - COVERAGE_WEIGHT), 4)


def calibrate(similarity: Column, floor: float) -> Column:
    """What lies above a floor, stretched to 0..1, to four places."""
    if floor >= 1:
        raise ValueError("the floor of a similarity is below 1")
    return F.round(clamp((similarity - floor) / (1 - floor)), 4)


def hybrid_score(scores: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the components that are not null, to four places; 0 where none is."""
    total = weight = F.lit(0.0)
    for name, score in scores.items():
        total = total + F.when(score.isNotNull(), clamp(score) * weights.get(name, 0.0)).otherwise(F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), F.lit(weights.get(name, 0.0))).otherwise(F.lit(0.0))
    return F.when(weight > 0, F.round(total / weight, 4)).otherwise(F.lit(0.0))
