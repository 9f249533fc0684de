"""Priority strategies as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def advantage_priority(reward: Column, mean: Column, eps: float = 1e-6) -> Column:
    return F.abs(reward - mean) + eps


def target_priority(pass_rate: Column, target: float = 0.5, width: float = 0.25, eps: float = 1e-6) -> Column:
    z = (pass_rate - target) / width
    return F.exp(z * z * -0.5) + eps


def variance_priority(pass_rate: Column, eps: float = 1e-6) -> Column:
    return pass_rate * (F.lit(1.0) - pass_rate) + eps


def drift_priority(base: Column, log_ratio: Column, sensitivity: float = 1.0) -> Column:
    """base / (1 + s |r|); null (keep what is) where the ratio isn't finite."""
    finite = log_ratio.isNotNull() & ~F.isnan(log_ratio) & (F.abs(log_ratio) < float("inf"))
    return F.when(finite, base / (F.lit(1.0) + F.abs(log_ratio) * sensitivity))


def stored_priority(reward: Column, eps: float = 1e-6) -> Column:
    return F.abs(reward) + eps


def importance_weight(n: Column, value: Column, total: Column, least: Column, beta: float) -> Column:
    """Float form of (n p / total)**-beta over the same for the least positive p."""
    one = F.pow(n * value.cast("double") / total.cast("double"), F.lit(-beta))
    return one / F.pow(n * least.cast("double") / total.cast("double"), F.lit(-beta))


def clipped_weight(n: Column, prob: Column, beta: float) -> Column:
    """Float replay weight in [0, 1], probabilities floored at 1e-10, by the largest weight given."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(n * F.greatest(prob, F.lit(1e-10)), F.lit(-beta))))


def reinforce_advantage(reward: Column) -> Column:
    """+0.1 for a success, -1 for a failure, 0 where there is no reward."""
    return F.when(reward.isNull() | F.isnan(reward), F.lit(0.0)).when(reward > 0, F.lit(0.1)).otherwise(F.lit(-1.0))
