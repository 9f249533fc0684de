"""What a verified log says about its examples: exposure, mixture by version window, reach, rows of batches."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.operators import eventlog as L
from embertide.operators import replay as R
from embertide.operators import verify as V
from embertide.operators.scan import running_sum

_SUM = T.StructType([T.StructField("num", T.StringType()), T.StructField("den", T.StringType()), T.StructField("f", T.DoubleType())])


@F.pandas_udf(_SUM)
def _exact_sum(nums: pd.Series, dens: pd.Series, counts: pd.Series) -> pd.DataFrame:
    rows = []
    for ns, ds, cs in zip(nums, dens, counts, strict=True):
        total = sum((Fraction(int(n), int(d)) * int(c) for n, d, c in zip(ns, ds, cs, strict=True)), Fraction(0))
        rows.append((str(total.numerator), str(total.denominator), float(total)))
    return pd.DataFrame(rows, columns=["num", "den", "f"])


class Transcript:
    """A log replayed once: clocked records, mutations, and draws with the example each selected."""

    def __init__(self, log: DataFrame):
        self.decay, _ = V.config(log)
        self.clocked = V.cut(R.clock(log), "clock")
        self.moved = V.cut(R.mutations(self.clocked, self.decay), "mutations")
        self.draws = V.cut(R.occupant(self.moved, R.draws_of(self.clocked)), "draws")

    def inserts(self) -> DataFrame:
        """Inserts with a digest: ord, slot, version, source, and the record that evicted them (null: live)."""
        rows = self.moved.where("op = 'insert' and content_digest is not null").select("ord", "slot", F.col("t").alias("version"), "content_digest", "source")
        evicts = self.moved.where("op = 'evict'").select("slot", F.col("ord").alias("evicted_at"))
        ends = L.lifetimes(rows.select("slot", "ord", F.lit("insert").alias("op")).unionByName(evicts.select("slot", F.col("evicted_at").alias("ord"), F.lit("evict").alias("op"))))
        return rows.join(ends.select("slot", "ord", F.when(F.col("end_op") == "evict", F.col("end_ord")).alias("evicted_at")), ["slot", "ord"])

    def exposure(self) -> DataFrame:
        """Per example (never-sampled ones too): times, exact sum of weights, first and last sample, its inserts in order.

        Equal weights are counted before they meet, so an example meets its distinct weights.
        """
        drawn = self.draws.where("held_digest is not null")
        per = drawn.groupBy(F.col("held_digest").alias("content_digest"), "w_num", "w_den").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
        weight = F.struct("w_num", "w_den", F.col("n").cast("string").alias("n"))
        per = per.groupBy("content_digest").agg(F.sum("n").alias("times"), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.collect_list(weight).alias("ws"))
        per = per.withColumn("weight", _exact_sum("ws.w_num", "ws.w_den", "ws.n")).drop("ws")
        own = self.inserts().groupBy("content_digest").agg(F.min_by("source", "ord").alias("source"), F.sort_array(F.collect_list(F.struct("ord", "slot", "version", "evicted_at"))).alias("inserts"))
        out = own.join(per, "content_digest", "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
        return out.select("content_digest", "source", "times", F.col("weight.num").alias("weight_num"), F.col("weight.den").alias("weight_den"), "first_ord", "last_ord", "inserts")

    def mixture(self) -> DataFrame:
        """Per source: inserted, sampled, share."""
        return L.mixture(self.inserts(), self.draws.where("held_digest is not null").withColumnRenamed("held_source", "source"))

    def windows(self) -> DataFrame:
        """Per version window (one opens at every advance): version, and draws by source, windows without any kept."""
        told = running_sum(self.clocked.select("ord", "op", "version"), "ord", (F.col("op") == "advance_version").cast("int"), "window", kind="bigint")
        drawn = self.draws.where("held_digest is not null").select("ord", F.coalesce("held_source", F.lit("(none)")).alias("source")).join(told.select("ord", "window"), "ord")
        counts = drawn.groupBy("window", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("window").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("by_source"))
        every = told.groupBy("window").agg(F.max("version").alias("version"), F.min("ord").alias("from_ord"), F.max("ord").alias("to_ord"))
        return every.join(counts, "window", "left")

    def radius(self, digests: DataFrame) -> DataFrame:
        """Per asked example (content_digest): times sampled, rows and steps of batches it reached, draws unwitnessed and declined, quarantines."""
        asked = digests.select("content_digest").distinct()
        drawn = self.draws.select(F.col("held_digest").alias("content_digest"), "sample_op", "k").join(asked, "content_digest")
        batches = self.clocked.where("op = 'batch'").select(F.col("sample_op_counter").alias("sample_op"), F.coalesce("declined", F.array().cast("array<string>")).alias("gone"))
        drawn = drawn.join(batches, "sample_op", "left").groupBy("content_digest").agg(
            F.count(F.lit(1)).alias("times"), F.count_if(F.col("gone").isNull()).alias("unwitnessed"), F.count_if(F.array_contains("gone", F.col("k").cast("string"))).alias("declined"))
        rows = R.placed_rows(self.clocked).join(asked, "content_digest").groupBy("content_digest").agg(
            F.sort_array(F.collect_list(F.struct("step", "row", F.col("k").alias("draw")))).alias("rows"), F.sort_array(F.collect_set("step")).alias("steps"))
        evicts = self.moved.where("op = 'evict' and reason = 'quarantine'").select("ord", "slot", "predicate")
        held = R.occupant(self.moved, evicts).select(F.col("held_digest").alias("content_digest"), "ord").join(asked, "content_digest")
        held = held.groupBy("content_digest").agg(F.sort_array(F.collect_list("ord")).alias("quarantined"))
        stored = self.inserts().join(asked, "content_digest").groupBy("content_digest").agg(F.count(F.lit(1)).alias("inserts"))
        out = asked.join(stored, "content_digest", "left").join(drawn, "content_digest", "left").join(rows, "content_digest", "left").join(held, "content_digest", "left")
        return out.withColumn("found", F.col("inserts").isNotNull()).fillna(0, ["inserts", "times", "unwitnessed", "declined"])
