"""Experiment analytics: rolling means, targets, budgets, summaries, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.operators.scan import ranked

#: Items of an arm that a task of the bootstrap holds.
ITEM_BLOCK = 50_000


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rolling(value: Column, keys: list[str], order: str, width: int) -> Column:
    """Mean of the finite ones of the last `width` values; null where there are none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)
    return F.avg(finite(value)).over(w)


def last_quarter(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last max(1, n div 4) rows of each key."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = df.withColumns({"__rank": F.row_number().over(back), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return ranked.where(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 4))).drop("__rank", "__n")


def within_budget(df: DataFrame, keys: list[str], order: str, cost: str, budget: float) -> DataFrame:
    """The rows before the first one whose running cost exceeds the budget."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = df.withColumn("spent", F.sum(cost).over(w))
    return spent.withColumn("__over", F.max((F.col("spent") > budget).cast("int")).over(w)).where("__over = 0").drop("__over")


def running_z(value: Column, keys: list[str], order: str, width: int = 20, least: int = 5) -> Column:
    """z-score against the `width` values before this one; null with fewer than `least` or no spread."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-width, -1)
    std = F.stddev_samp(value).over(w)
    return F.when((F.count(value).over(w) >= least) & (std > 0), (value - F.avg(value).over(w)) / std)


def reward_sum(values: list[Column], weights: list[float]) -> Column:
    """Weighted sum that leaves abstentions (null or NaN) out; null if all abstain."""
    held = [F.when(~F.isnan(v), v * w) for v, w in zip(values, weights, strict=True)]
    total = sum((F.coalesce(h, F.lit(0.0)) for h in held), F.lit(0.0))
    return F.when(F.coalesce(*held).isNotNull(), total)


def percentile_bounds(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """0-based ranks of the bounds in n sorted resamples."""
    return math.floor(alpha / 2 * (n - 1)), math.ceil((1 - alpha / 2) * (n - 1))


def bootstrap(df: DataFrame, keys: list[str], seed_col: str, item_col: str, score: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Per arm (keys): mean, lo, hi: the 95 % percentile interval of the mean over seeds x items, both drawn with replacement.

    A resample draws one list of seeds and one list of items and averages their cross. Every seed must score the same items, else an
    error; (arm, seed, item) is unique. Items of an arm are cut into blocks of ITEM_BLOCK: a task makes the draws of all resamples anew
    (PCG64 of `seed`, the same in each) and adds up its own items, so an arm of any size is shared by many tasks.
    """
    per = df.groupBy(*keys, seed_col).agg(F.count(F.lit(1)).alias("items"), F.countDistinct(item_col).alias("distinct"))
    shape = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("distinct").alias("n"), F.max("items").alias("most"))
    items = df.select(*keys, item_col).distinct()
    known = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"))
    shape = shape.join(known, keys).withColumn(
        "n", F.when((F.col("n") == F.col("most")) & (F.col("n") == F.col("of")), F.col("n")).otherwise(F.raise_error(F.lit("every seed must score the same items")).cast("long")))
    seeds = per.select(*keys, seed_col, (F.row_number().over(Window.partitionBy(*keys).orderBy(seed_col)) - 1).alias("s"))
    placed = df.join(ranked(items, item_col, "i", keys=keys), [*keys, item_col]).join(seeds, [*keys, seed_col]).join(F.broadcast(shape.select(*keys, "k", "n")), keys)
    placed = placed.withColumn("block", F.floor(F.col("i") / ITEM_BLOCK)).select(*keys, "block", "s", "i", "k", "n", F.col(score).cast("double").alias("x"))

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k, n, first = int(pdf["k"].iloc[0]), int(pdf["n"].iloc[0]), int(key[-1]) * ITEM_BLOCK
        matrix = np.zeros((k, min(ITEM_BLOCK, n - first)))
        matrix[pdf["s"].to_numpy(), pdf["i"].to_numpy() - first] = pdf["x"].to_numpy()
        rng, sums = np.random.default_rng(seed), np.empty(resamples)
        for r in range(resamples):
            chosen = np.bincount(rng.integers(0, k, size=k), minlength=k)
            drawn = rng.integers(0, n, size=n) - first
            times = np.bincount(drawn[(drawn >= 0) & (drawn < matrix.shape[1])], minlength=matrix.shape[1])
            sums[r] = chosen @ matrix @ times
        out = pd.DataFrame({"r": np.arange(resamples), "part": sums / (k * n), "own": matrix.sum() / (k * n)})
        for name, value in reversed(list(zip(keys, key, strict=False))):
            out.insert(0, name, value)
        return out

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    parts = placed.groupBy(*keys, "block").applyInPandas(draw, f"{kinds}, r long, part double, own double")
    means = parts.groupBy(*keys, "r").agg(F.sum("part").alias("m"), F.sum("own").alias("mean"))
    lo, hi = percentile_bounds(resamples)
    means = means.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("m")) - 1)  # one row for each resample
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("m")))
    return means.groupBy(*keys).agg(F.max("mean").alias("mean"), at(lo).alias("lo"), at(hi).alias("hi"))


def paired_bootstrap(arms: DataFrame, base: DataFrame, keys: list[str], seed_col: str, item_col: str, score: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """bootstrap of the item-wise difference of each arm to base on the seeds that both have, with how many seeds lie above base."""
    common = arms.join(base.select(seed_col).distinct(), seed_col, "left_semi")
    both = common.join(base.select(seed_col, item_col, F.col(score).alias("__base")), [seed_col, item_col])
    diff = both.select(*keys, seed_col, item_col, (F.col(score) - F.col("__base")).alias(score))
    per = diff.groupBy(*keys, seed_col).agg(F.avg(score).alias("__point"))
    above = per.groupBy(*keys).agg(F.count_if(F.col("__point") > 0).alias("above"), F.count(F.lit(1)).alias("seeds"))
    return bootstrap(diff, keys, seed_col, item_col, score, resamples, seed).join(above, keys)
