"""Scalar score, relevance and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the score preservation metrics, and bytes a component by type.
METRICS = (
    "relative_score_dissimilarity", "absolute_score_utility", "squared_score_utility", "relative_margin_utility",
    "hybrid_score_margin_utility"
)
MARGIN_METRICS = METRICS[3:]
DTYPE_BYTES = {"float16": 2, "bfloat16": 2, "float32": 4}


def relative(full: Column, reduced: Column, epsilon: float = 1e-6) -> Column:
    """1 - |s - s'| / |s|; below 0 where scores differ by more than their size."""
    return 1 - F.abs(full - reduced) / F.greatest(F.abs(full), F.lit(epsilon))


def absolute(full: Column, reduced: Column) -> Column:
    return 1 / (1 + F.abs(full - reduced))


def squared(full: Column, reduced: Column) -> Column:
    return 1 / (1 + (full - reduced) * (full - reduced))


def margin(full: Column, reduced: Column, full_negative: Column, reduced_negative: Column, epsilon: float = 1e-6) -> Column:
    return relative(full - full_negative, reduced - reduced_negative, epsilon)


def preservation(
    metric: str, full: Column, reduced: Column, full_negative: Column | None = None,
    reduced_negative: Column | None = None, size: Column | None = None, epsilon: float = 1e-6, alpha: float = 0.7
) -> Column:
    """By name. Margin metrics need the negatives and the size of the query's group; a group of one is preserved wholly."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric in MARGIN_METRICS:
        m = margin(full, reduced, full_negative, reduced_negative, epsilon)
        value = m if metric == METRICS[3] else alpha * relative(full, reduced, epsilon) + (1 - alpha) * m
        return F.when(size <= 1, 1.0).otherwise(value)
    return {
        METRICS[0]: lambda: relative(full, reduced, epsilon), METRICS[1]: lambda: absolute(full, reduced),
        METRICS[2]: lambda: squared(full, reduced)
    }[metric]()


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def unit_scale(x: Column, low: float, high: float) -> Column:
    return (clip(x, low, high) - low) / max(high - low, 1e-9)


def rank_discount(rank0: Column) -> Column:
    """1 / log2(rank + 2) of a rank from 0."""
    return clip(1 / F.log2(rank0 + 2))


def label_lookup(label: Column, mapping: dict[str, float], otherwise: Column) -> Column:
    """mapping[label as an integer], or `otherwise` where there is none."""
    if not mapping:
        return otherwise
    pairs = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), float(v))])
    return F.coalesce(F.try_element_at(pairs, label.cast("bigint").cast("string")), otherwise)


def impact(relevance: Column, uncertainty: Column) -> Column:
    return F.abs(relevance) * (1 + F.coalesce(uncertainty, F.lit(1.0)))


def number(x: Column) -> Column:
    """As a double, null where it is none."""
    return x.try_cast("double")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9._-]+", "-"), "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def budget_bytes(budget_bytes: int | None, budget_gb: float | None) -> int:
    """Bytes win over gibibytes."""
    if budget_bytes is not None:
        return int(budget_bytes)
    if budget_gb is None:
        raise ValueError("a budget is needed")
    return int(budget_gb * 1024**3)


def rbp_masses(total: float, expected_fraction: float, cap: float, n: int) -> tuple[float, float]:
    """Expected and uncertain relevance of each of n unranked documents that share the residual `total`."""
    expected = total * expected_fraction
    uncertain = max(0.0, total - expected)
    return (min(cap, expected / n), uncertain / n) if n else (0.0, 0.0)
