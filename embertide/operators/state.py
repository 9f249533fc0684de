"""Lifecycle of live entries as set operations on a state DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.operators.scan import ranked


def oldest(state: DataFrame, count: int) -> DataFrame:
    """The entries that a full buffer gives up first: by version, then insertion."""
    return state.orderBy("version", "insert_seq").limit(count)


def free_slots(capacity: int, state: DataFrame) -> DataFrame:
    """Slots of range(capacity) that no entry holds."""
    return state.sparkSession.range(capacity).withColumnRenamed("id", "slot").join(state.select("slot"), "slot", "left_anti")


def allocate(members: DataFrame, free: DataFrame, order: str) -> DataFrame:
    """The i-th member by order gets the i-th lowest free slot."""
    a, b = ranked(members, order, "nth"), ranked(free, "slot", "nth")
    return a.join(b, "nth").drop("nth")


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Writes and evictions by slot, the last one by seq: insert, update, or delete (op = 'evict')."""
    last = changes.groupBy("slot").agg(F.max_by(F.struct("op", "q", "version"), "seq").alias("c"))
    both = state.join(last, "slot", "full")
    pick = lambda n: F.when(F.col("c").isNotNull(), F.col(f"c.{n}")).otherwise(F.col(n)).alias(n)
    return both.where("c is null or c.op <> 'evict'").select("slot", pick("q"), pick("version"))


def capacity_evictions(groups: DataFrame, capacity: int) -> DataFrame:
    """For groups (version, size) in order: entries that each arrival pushes out of a buffer of `capacity`."""
    w = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # one row for each version
    filled = groups.withColumn("total", F.sum("size").over(w))
    over = F.greatest(F.col("total") - capacity, F.lit(0))
    before = F.greatest(F.col("total") - F.col("size") - capacity, F.lit(0))
    return filled.withColumn("evicted", over - before)


def quarantine(state: DataFrame, predicate: Column) -> DataFrame:
    """Entries that the predicate selects, null counting as no, in slot order."""
    return state.where(F.coalesce(predicate, F.lit(False))).orderBy("slot")


def ring(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """Content of a circular buffer: the last row written to each slot order mod capacity."""
    slot = F.pmod(F.col(order), F.lit(capacity)).alias("slot")
    return rows.groupBy(slot).agg(F.max(order).alias(order)).join(rows, order)
