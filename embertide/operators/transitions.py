"""Classic transitions: n-step returns, hindsight goals, running normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episodes(df: DataFrame, env: str, order: str, done: Column) -> DataFrame:
    """df with `episode`: how many episodes of its environment ended before each row."""
    w = Window.partitionBy(env).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("episode", F.coalesce(F.sum(done.cast("long")).over(w), F.lit(0)))


def nstep_returns(df: DataFrame, env: str, order: str, reward: Column, done: Column, n: int, gamma: float) -> DataFrame:
    """G = sum gamma**k r over up to n rows, not past a terminal row; steps used, last row's order, its done.

    Rows at the tail of an environment that never ended wait for more and aren't returned.
    """
    w = Window.partitionBy(env, "episode").orderBy(order).rowsBetween(0, n - 1)
    rows = episodes(df, env, order, done).withColumn("__w", F.collect_list(F.struct(reward.alias("r"), done.alias("d"), F.col(order).alias("o"))).over(w))
    g = F.aggregate(
        F.transform("__w", lambda x, i: x.r * F.pow(F.lit(gamma), i)), F.lit(0.0), lambda a, x: a + x
    )
    last = F.element_at("__w", -1)
    full = (F.size("__w") == n) | last.d
    return rows.where(full).select(env, order, g.alias("g"), F.size("__w").cast("long").alias("steps"), last.o.alias("last"), last.d.alias("done"))


def hindsight(df: DataFrame, episode: str, order: str, goal: str, strategy: str, k: int = 1) -> DataFrame:
    """Rows relabelled with goals that their episode reached: `final`, `future` (k keyed choices from now on) or `episode` (k of all).

    A future index is t + hash mod (T - t), one of the episode hash mod T, so that every engine can make it.
    """
    own = Window.partitionBy(episode)
    rows = df.withColumns({"t": F.row_number().over(own.orderBy(order)) - 1, "len": F.count(F.lit(1)).over(own)})
    reached = rows.select(episode, F.col("t").alias("at"), F.col(goal).alias("new_goal"))
    if strategy == "final":
        asked = rows.withColumn("at", F.col("len") - 1).withColumn("j", F.lit(0))
    elif strategy in ("future", "episode"):
        asked = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        first = F.col("t") if strategy == "future" else F.lit(0)
        asked = asked.withColumn("at", first + F.pmod((F.col(order) * 31 + F.col("j") * 17 + 7), F.col("len") - first))
    else:
        raise ValueError("strategy must be final, future or episode")
    return asked.withColumn("at", F.col("at").cast("long")).join(reached.withColumn("at", F.col("at").cast("long")), [episode, "at"])


def running_moments(df: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Count, mean and variance so far; the variance starts from one and divides by n - 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    var = F.when(n > 1, F.var_samp(value).over(w) + F.lit(1.0) / (n - 1)).otherwise(F.lit(1.0))
    return df.withColumns({"n": n, "mean": F.avg(value).over(w), "var": var})


def total_variation(p: Column, q: Column) -> Column:
    return F.sum(F.abs(p - q)) * 0.5


def annealed_beta(beta: float, end: float, total: int, steps: Column) -> Column:
    """beta after calls 1 .. steps, each moving from where it is: min(end, b + (end - b) i / total)."""
    return F.aggregate(
        F.sequence(F.lit(1), steps.cast("int")), F.lit(beta), lambda b, i: F.least(F.lit(end), b + (F.lit(end) - b) * i / total)
    )


def td_error(reward: Column, next_value: Column, done: Column, value: Column, gamma: float = 0.99) -> Column:
    return reward + gamma * next_value * F.when(done, 0.0).otherwise(1.0) - value
