"""Column functions for rates, intervals and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """(point, lower, upper) of the Wilson interval, clamped to [0, 1]; zeros where total is 0."""
    k, n = successes.cast("double"), F.nullif(total.cast("double"), F.lit(0.0))
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    mid, scale = p + z * z / (2 * n), 1 + z * z / n
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return zero(p), F.greatest(F.lit(0.0), zero((mid - half) / scale)), F.least(F.lit(1.0), zero((mid + half) / scale))


def rate_columns(successes: Column, total: Column) -> list[Column]:
    """successes, total, point, lower and upper."""
    p, lo, hi = wilson(successes, total)
    return [successes.alias("successes"), total.alias("total"), p.alias("point"), lo.alias("lower"), hi.alias("upper")]


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def orientation_adjusted(auc: Column) -> Column:
    """The AUC of the better direction."""
    return F.greatest(auc, 1 - auc)


def binary_cross_entropy(logit: Column, y: Column) -> Column:
    """In the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def auc_from_ranks(rank_sum: Column, positives: Column, negatives: Column) -> Column:
    """The area under the ROC curve from the positives' average ranks; null without both classes."""
    p, n = positives.cast("double"), negatives.cast("double")
    return F.when((p > 0) & (n > 0), (rank_sum - p * (p + 1) / 2) / (p * n))
