"""Questions over an append-only event log: occupants, windows, exposure, mixture, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.operators.scan import running_sum

#: Operation of each event type, where events stand in for a log.
OPS = {"signup": "insert", "purchase": "sample", "error": "evict", "view": "update", "click": "advance_version"}


def log_of_events(events: DataFrame) -> DataFrame:
    """events as a log: ord, op, slot, source, value, step."""
    op = F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv))[F.col("event_type")]
    return events.select(
        F.col("event_id").alias("ord"), op.alias("op"), F.col("user_id").alias("slot"),
        F.col("event_type").alias("kind"), "value", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("step"),
    )


def occupants(log: DataFrame) -> DataFrame:
    """Each sample with the insert that its slot held (as-of; null if none, or evicted since)."""
    w = Window.partitionBy("slot").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op").isin("insert", "evict"), F.struct("ord", "op"))
    last = log.withColumn("__last", F.last(change, ignorenulls=True).over(w))
    inserted = F.when(F.col("__last.op") == "insert", F.col("__last.ord"))
    return last.where("op = 'sample'").withColumn("insert_ord", inserted).drop("__last")


def lifetimes(log: DataFrame) -> DataFrame:
    """Each insert with the ord that ended it (the next insert or evict of its slot, null if live) and how."""
    w = Window.partitionBy("slot").orderBy("ord")
    ends = log.where("op in ('insert', 'evict')")
    ends = ends.withColumns({"end_ord": F.lead("ord").over(w), "end_op": F.lead("op").over(w)})
    return ends.where("op = 'insert'")


def version_windows(log: DataFrame) -> DataFrame:
    """log with `window`: how many version advances stand at or before each record."""
    return running_sum(log, "ord", (F.col("op") == "advance_version").cast("int"), "window", kind="bigint")


def exposure(log: DataFrame) -> DataFrame:
    """Each insert with times sampled, first and last sample; never-sampled inserts kept."""
    hits = occupants(log).where("insert_ord is not null").groupBy("insert_ord").agg(
        F.count(F.lit(1)).alias("times"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    own = log.where("op = 'insert'").select(F.col("ord").alias("insert_ord"), "slot")
    return own.join(hits, "insert_ord", "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mixture(inserted: DataFrame, sampled: DataFrame, source: str = "source") -> DataFrame:
    """Per source: inserted, sampled, share of all sampled (0 if none); untagged rows are '(none)'."""
    tag = F.coalesce(source, F.lit("(none)")).alias("source")
    a = inserted.groupBy(tag).agg(F.count(F.lit(1)).alias("inserted"))
    b = sampled.groupBy(tag).agg(F.count(F.lit(1)).alias("sampled"))
    both = a.join(b, "source", "full").select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inserted", "sampled")))
    total = F.sum("sampled").over(Window.partitionBy())  # one row for each source
    return both.withColumn("share", F.when(total > 0, F.col("sampled") / total).otherwise(F.lit(0.0)))


def quota_verdicts(mix: DataFrame, quotas: DataFrame) -> DataFrame:
    """Each quota (source, allowed) with sampled, whether the source is present, and whether it holds."""
    q = quotas.join(mix.select("source", "sampled"), "source", "left")
    n = F.coalesce("sampled", F.lit(0))
    return q.select("source", "allowed", n.alias("sampled"), F.col("sampled").isNotNull().alias("present"), (n <= F.col("allowed")).alias("ok"))


def first_difference(left: DataFrame, right: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """The first order at which two logs differ, with the names of the fields that do (none: no row)."""
    a = left.select(order, F.struct(*fields).alias("a"))
    b = right.select(order, F.struct(*fields).alias("b"))
    both = a.join(b, order, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    names = F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return both.orderBy(order).limit(1).select(order, F.array_join(F.array_sort(names), ",").alias("fields"))


def uncovered(declared: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows declared but not placed exactly once, and placed but not declared."""
    a = declared.groupBy(*keys).agg(F.count(F.lit(1)).alias("declared"))
    b = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("placed"))
    both = a.join(b, keys, "full").fillna(0, ["declared", "placed"])
    return both.where("declared <> 1 or placed <> 1")


def disagreeing(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows of left whose value a isn't the value b that right has for their keys (or has none)."""
    return left.join(right.select(*keys, b), keys, "left").where(~F.col(a).eqNullSafe(F.col(b)))


def differing(left: DataFrame, right: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Each order at which two logs differ: the fields that do, or `missing` / `extra` where only one has it."""
    both = left.select(order, F.struct(*fields).alias("a")).join(right.select(order, F.struct(*fields).alias("b")), order, "full")
    same = [F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    told = [F.when(F.col("b").isNull(), F.lit("missing")), F.when(F.col("a").isNull(), F.lit("extra")), *same]
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(order, F.concat_ws(",", *told).alias("fields"))


def not_persisting(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows that leave out a value declared earlier under their keys (left_out), or differ from the first one (changed)."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__first", first)
    left, changed = F.col("__first").isNotNull() & F.col(value).isNull(), F.coalesce(F.col(value) != F.col("__first"), F.lit(False))
    return rows.withColumns({"left_out": left, "changed": changed}).where("left_out or changed").drop("__first")


def canonical_int(text: Column) -> Column:
    """Whether a text is a whole number as the log spells one: digits without sign, space or leading zero."""
    return text.rlike("^(0|[1-9][0-9]*)$")
