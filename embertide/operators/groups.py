"""Rollout ingestion and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reward bound of a valid rollout (fixed value: 2**500).
MAX_REWARD = float(2**500)


def rollouts_of_events(events: DataFrame, first_day: str = "2024-01-01") -> DataFrame:
    """events as rollouts: prompt, version, member, source, reward, success."""
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    return events.select(
        "event_id",
        F.col("user_id").alias("prompt_id"),
        F.datediff(F.to_date("ts"), F.lit(first_day)).cast("long").alias("version"),
        (F.row_number().over(order) - 1).cast("long").alias("member"),
        F.col("event_type").alias("source"),
        (F.col("value") / 100).alias("reward"),
        (F.col("value") > 100).alias("success"),
    )


def valid_rollout(tokens: Column, logprobs: Column, reward: Column) -> Column:
    """Non-empty tokens from 0, as many finite log-probabilities up to 0, a finite bounded reward."""
    return (
        (F.size(tokens) > 0)
        & F.forall(tokens, lambda t: t >= 0)
        & (F.size(logprobs) == F.size(tokens))
        & F.forall(logprobs, lambda p: (p <= 0) & ~F.isnan(p) & (p > float("-inf")))
        & ~F.isnan(reward)
        & (F.abs(reward) <= MAX_REWARD)
    )


def valid_source(source: Column) -> Column:
    """No tag, or 1 to 256 characters, not blank."""
    return source.isNull() | ((F.length(source) <= 256) & (F.length(F.trim(source)) > 0))


def exact_sum(x: Column) -> Column:
    """Sum that no row order changes: six decimals."""
    return F.sum(x.cast("decimal(28,6)"))


def group_stats(rollouts: DataFrame, keys: tuple[str, ...] = ("prompt_id", "version")) -> DataFrame:
    """n, mean_reward, reward_std (population), n_success, pass_rate of each group."""
    r = F.col("reward")
    total = exact_sum(r).cast("double")
    squares = F.sum((r * r).cast("decimal(38,12)")).cast("double")
    n = F.count(F.lit(1))
    stats = rollouts.groupBy(*keys).agg(
        n.alias("n"), total.alias("s"), squares.alias("ss"), F.count_if("success").alias("n_success")
    )
    mean = F.col("s") / F.col("n")
    return stats.select(
        *keys,
        "n",
        mean.alias("mean_reward"),
        F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("reward_std"),
        "n_success",
        (F.col("n_success") / F.col("n")).alias("pass_rate"),
    )


def with_stats(rollouts: DataFrame, keys: tuple[str, ...] = ("prompt_id", "version")) -> DataFrame:
    """Rollouts with mean_reward, pass_rate and advantage of their group: one shuffle, no join."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    out = rollouts.withColumns({
        "mean_reward": F.sum(F.col("reward").cast("decimal(28,6)")).over(w).cast("double") / n,
        "pass_rate": F.sum(F.col("success").cast("int")).over(w) / n,
    })
    return out.withColumn("advantage", F.col("reward") - F.col("mean_reward"))
