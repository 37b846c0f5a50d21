"""Static risk of a prompt and its tools: thresholded metrics, weighted into one score. Expressions over metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where each metric's risk becomes medium and high, and its weight in the whole. Description quality counts the other way round.
THRESHOLDS = {
    "total_params": (7, 10),
    "schema_complexity": (12, 18),
    "schema_depth": (3, 5),
    "num_tools": (5, 8),
    "tool_name_ambiguity": (0.5, 0.7),
    "query_length": (400, 600),
    "optional_param_ratio": (0.3, 0.5),
    "param_type_diversity": (3, 5),
    "enum_gap": (0.5, 0.8),
    "description_quality": (0.6, 0.3),
}
WEIGHTS = {
    "total_params": 0.17,
    "schema_complexity": 0.17,
    "schema_depth": 0.08,
    "num_tools": 0.08,
    "tool_name_ambiguity": 0.08,
    "optional_param_ratio": 0.10,
    "query_length": 0.05,
    "param_type_diversity": 0.04,
    "vague_terms": 0.04,
    "constraint_score": 0.04,
    "enum_gap": 0.08,
    "description_quality": 0.07,
}
NEED_PARAMS = 2
HIGH, MEDIUM = 0.6, 0.3


def normalised(value: Column, medium: float, high: float) -> Column:
    """0 to 0.1 up to medium, to 0.5 up to high, then to 1 at twice high."""
    v = value.cast("double")
    beyond = F.least(0.5 + 0.5 * (v - high) / max(high, 1), F.lit(1.0))
    return F.when(v <= 0, 0.0).when(v < medium, 0.1 * v / medium).when(v < high, 0.1 + 0.4 * (v - medium) / (high - medium)).otherwise(beyond)


def poor_descriptions(quality: Column) -> Column:
    medium, high = THRESHOLDS["description_quality"]
    below = F.least(0.5 + 0.5 * (high - quality) / max(high, 0.01), F.lit(1.0))
    return F.when(quality >= medium, 0.1 * (1 - quality) / max(1 - medium, 0.01)).when(quality >= high, 0.1 + 0.4 * (medium - quality) / max(medium - high, 0.01)).otherwise(below)


def overall_risk(metrics: dict[str, Column]) -> Column:
    """The weighted risk of the metrics given; metrics not given do not count. vague_term_count and constraint_density feed their two weights."""
    total = F.lit(0.0)
    enough = metrics.get("total_params", F.lit(0)) >= NEED_PARAMS
    for name, weight in WEIGHTS.items():
        if name == "vague_terms":
            part = F.least(metrics.get("vague_term_count", F.lit(0)) / 5.0, F.lit(1.0))
        elif name == "constraint_score":
            part = F.greatest(1 - metrics.get("constraint_density", F.lit(0.0)) * 10, F.lit(0.0))
        elif name not in metrics:
            continue
        elif name == "description_quality":
            part = F.when(enough, poor_descriptions(metrics[name])).otherwise(0.0)
        else:
            part = normalised(metrics[name], *THRESHOLDS[name])
            part = F.when(enough, part).otherwise(0.0) if name == "enum_gap" else part
        total = total + weight * part
    return F.least(total, F.lit(1.0))


def level(risk: Column) -> Column:
    return F.when(risk >= HIGH, "high").when(risk >= MEDIUM, "medium").otherwise("low")


def complexity(depth: Column, params: Column, types: Column) -> Column:
    return depth * F.sqrt(params) * (1 + 0.2 * types)


def description_score(text: Column) -> Column:
    """0 for none, then 0.3, 0.6 and 1 by length."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0.0).when(n < 10, 0.3).when(n < 30, 0.6).otherwise(1.0)
