"""Exact age-decayed priority sampling over a live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.decay import Decay, expired, leaf, quantize
from embertide.operators.scan import ROWS, blocked, running_sum


def live_state(rollouts: DataFrame, decay: Decay, now: int, score: Column, order: str = "event_id") -> DataFrame:
    """slot, q, version, leaf and the row's own columns for entries that haven't expired; slot = order."""
    base = decay.base_epoch(now)
    rows = rollouts.where(~expired(F.col("version"), now, decay.max_age)).where(F.col("version") <= now)
    rows = rows.withColumn("q", quantize(score)).withColumn("slot", F.col(order))
    return rows.withColumn("leaf", leaf(F.col("q"), F.col("version"), base, decay.half_life))


def prefix(state: DataFrame, order: str = "slot") -> DataFrame:
    """state with cum_after, the exact sum of leaves up to each slot."""
    return running_sum(state, order, F.col("leaf"), "cum_after")


def totals(state: DataFrame) -> DataFrame:
    """One row: n (zero-weight entries too), total, least (smallest positive leaf)."""
    return state.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("leaf").cast("decimal(38,0)").alias("total"),
        F.min(F.when(F.col("leaf") > 0, F.col("leaf"))).alias("least"),
    )


def _within(intervals: DataFrame, points: DataFrame, point: str, keys: list[str], bands: int) -> DataFrame:
    """Range join on equal keys: for each point the interval with lo <= point < hi, both sides carrying the keys' total.

    An interval is listed in each of `bands` equal shares of the total that it touches (its rows + bands in all, for
    each key), so the range condition rides on an equi-join.
    """
    band = lambda x: F.floor(x / F.ceil(F.col("total") / bands).cast("decimal(38,0)")).cast("long")
    listed = intervals.withColumn("__band", F.explode(F.sequence(band(F.col("lo")), band(F.col("hi") - 1)))).drop("total")
    asked = points.withColumn("__band", band(F.col(point))).drop("total")
    return listed.join(asked, [*keys, "__band"]).where((F.col("lo") <= F.col(point)) & (F.col(point) < F.col("hi"))).drop("__band")


def locate(state: DataFrame, draws: DataFrame, order: str = "slot", bands: int = 1024, rows: int = ROWS) -> DataFrame:
    """Inverse-CDF join: the entry whose interval of the running sum of leaf holds the draw, for each draw (column draw).

    Draws meet the sums of blocks first; only blocks that are hit are scanned, and there draws and entries meet
    by bands of the block. The table itself is summed map-side, not shuffled.
    """
    wide = "decimal(38,0)"
    held, blocks = blocked(state.where("leaf > 0"), order, "__block", rows)
    asked = draws.withColumn("__rest", F.col("draw").cast(wide))
    if blocks > 1:
        sums = held.groupBy("__block").agg(F.sum("leaf").cast(wide).alias("__sum"))
        sums = running_sum(sums, "__block", F.col("__sum"), "hi").withColumn("lo", (F.col("hi") - F.col("__sum")).cast(wide))
        top = F.broadcast(sums.agg(F.max("hi").alias("total")))  # one row
        met = _within(sums.crossJoin(top), asked.crossJoin(top), "__rest", [], bands)
        asked = met.select(*draws.columns, "__block", (F.col("__rest") - F.col("lo")).cast(wide).alias("__rest"), F.col("__sum").alias("total"))
        held = held.join(asked.select("__block").distinct(), "__block", "left_semi")
    own = Window.partitionBy("__block")
    held = held.withColumn("hi", F.sum("leaf").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast(wide))
    held = held.withColumns({"lo": (F.col("hi") - F.col("leaf")).cast(wide), "total": F.sum("leaf").over(own).cast(wide)})
    if blocks == 1:
        top = F.broadcast(state.agg(F.sum("leaf").cast(wide).alias("total")))  # one row
        asked = asked.crossJoin(top).withColumn("__block", F.lit(0).cast("long"))
    return _within(held, asked, "__rest", ["__block"], bands).drop("__block", "__rest", "lo", "hi")


def exact_ess(df: DataFrame, keys: list[str], num: str, den: str) -> DataFrame:
    """Per key: ess_num, ess_den, ess: (sum w)**2 / sum w**2 over exact weights num / den.

    Equal weights are counted map-side first, so a key meets its distinct weights only.
    """
    from embertide.functions.exact import counted_ess_udf

    per = df.groupBy(*keys, num, den).agg(F.count(F.lit(1)).alias("__n"))
    text = lambda c: F.col(c).cast("string").alias(c)
    held = per.groupBy(*keys).agg(F.collect_list(F.struct(text(num), text(den), text("__n"))).alias("__w"))
    ess = counted_ess_udf(F.col(f"__w.{num}"), F.col(f"__w.{den}"), F.col("__w.__n"))
    return held.select(*keys, ess.alias("e")).select(*keys, F.col("e.num").alias("ess_num"), F.col("e.den").alias("ess_den"), F.col("e.f").alias("ess"))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is n or more (1 for 0)."""
    bits = F.length(F.bin(F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), bits).cast("long"))
