"""Batch mixing and the staleness policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Thresholds; None turns a stage off."""

    max_age: int | None = None
    ess_floor: float | None = None
    mass_cap: float | None = None
    max_log_ratio: float | None = None
    max_declines_per_step: int | None = None


def decide(draws: DataFrame, policy: Policy, step: str = "step") -> DataFrame:
    """draws (step, draw, ratio, w, age, grp) with reason (null, drift, age, ess) and scale.

    Stages in order: a ratio that isn't finite drifts; entries over max_age go; while the effective
    share of the kept weights is under the floor, the largest |ratio| goes (ties by draw); a group whose mass
    sum w exp(ratio) exceeds (1 + cap) n is scaled to it; what is kept with |ratio| over the limit drifts.

    The victim loop is one window: from the last victim back, sums of w and w**2 run over what is left before each drop, and
    the most rows that meet the floor stay. Weights are decimals of 12 places, so sums don't depend on order.
    All windows share one partitioning by step. A step with more declines than max_declines_per_step is an error.
    """
    ratio = F.col("ratio")
    ok = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < float("inf"))
    rows = draws.repartition(step).withColumn("reason", F.when(~ok, F.lit("drift")))
    if policy.max_age is not None:
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("age") > policy.max_age), "age").otherwise(F.col("reason")))
    if policy.ess_floor is not None:
        keep = F.col("reason").isNull()
        back = Window.partitionBy(step, keep).orderBy(F.abs("ratio"), F.desc("draw"))
        rest = back.rowsBetween(Window.unboundedPreceding, 0)
        w = F.col("w").cast("decimal(20,12)")
        rows = rows.withColumns({
            "__s": F.sum(w).over(rest).cast("double"), "__q": F.sum((w * w).cast("decimal(30,18)")).over(rest).cast("double"), "__left": F.row_number().over(back),
        })
        fine = (F.col("__left") <= 1) | (F.col("__s") * F.col("__s") >= policy.ess_floor * F.col("__left") * F.col("__q"))
        most = F.max(F.when(fine, F.col("__left"))).over(Window.partitionBy(step, keep))
        rows = rows.withColumn("reason", F.when(keep & (F.col("__left") > most), "ess").otherwise(F.col("reason")))
        rows = rows.drop("__s", "__q", "__left")
    scale = F.lit(1.0)
    if policy.mass_cap is not None:
        kept = F.col("reason").isNull()
        own = Window.partitionBy(step, "grp")
        mass = F.sum(F.when(kept, (F.col("w") * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("ratio"))))).cast("decimal(38,12)"))).over(own)
        cap = (1 + policy.mass_cap) * F.count_if(kept).over(own)
        scale = F.when(kept & (mass.cast("double") > cap), cap / mass.cast("double")).otherwise(F.lit(1.0))
    rows = rows.withColumn("scale", scale)
    if policy.max_log_ratio is not None:
        far = F.col("reason").isNull() & (F.abs("ratio") > policy.max_log_ratio)
        rows = rows.withColumn("scale", F.when(far, F.lit(1.0)).otherwise(F.col("scale")))
        rows = rows.withColumn("reason", F.when(far, F.lit("drift")).otherwise(F.col("reason")))
    if policy.max_declines_per_step is not None:
        n = F.count("reason").over(Window.partitionBy(step))
        broken = F.raise_error(F.concat(n.cast("string"), F.lit(f" declines in a step exceed {policy.max_declines_per_step}"))).cast("string")
        rows = rows.withColumn("reason", F.when(n > policy.max_declines_per_step, broken).otherwise(F.col("reason")))
    return rows


def refused_steps(decisions: DataFrame, most: int, step: str = "step") -> DataFrame:
    """Steps with more than `most` declines, which max_declines_per_step refuses."""
    return decisions.groupBy(step).agg(F.count("reason").alias("declined"), F.count(F.lit(1)).alias("n")).where(F.col("declined") > most)


def place(decisions: DataFrame, reward: Column) -> DataFrame:
    """What a step writes: kept draws with the advantage reward * w * scale, declined ones with none; rescaled: kept with scale < 1."""
    kept = F.col("reason").isNull()
    return decisions.withColumns({
        "kept": kept, "advantage": F.when(kept, reward * (F.col("w") * F.col("scale"))), "rescaled": kept & (F.col("scale") < 1),
    })


def evictions(decisions: DataFrame, slot: str = "slot") -> DataFrame:
    """Slots all of whose draws were declined for drift or age; drift names the reason if any draw drifted."""
    bad = F.coalesce(F.col("reason").isin("drift", "age"), F.lit(False))
    g = decisions.groupBy(slot).agg(F.bool_and(bad).alias("all"), F.bool_or(F.coalesce(F.col("reason") == "drift", F.lit(False))).alias("drift"))
    return g.where("all").select(slot, F.when(F.col("drift"), "drift").otherwise("age").alias("reason"))


def step_telemetry(decisions: DataFrame, step: str = "step") -> DataFrame:
    """Counters of a step: rows, kept, declined by reason, rescaled, least scale, staleness, log-ratios."""
    r = F.col("reason")
    age = F.col("age").cast("long")
    return decisions.groupBy(step).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r.isNull()).alias("kept"),
        *(F.count_if(r == x).alias(f"declined_{x}") for x in ("drift", "age", "ess")),
        F.count_if(F.col("scale") < 1).alias("rescaled"), F.min("scale").alias("min_scale"),
        F.max(age).alias("staleness_max"), F.sum(age).alias("staleness_sum"), F.max(F.abs("ratio")).alias("max_log_ratio"),
    )


def pad(x: Column, width: int, fill, left: bool = False) -> Column:
    """x cut to width, or filled up to it on one side."""
    body = F.slice(x, 1, width)
    gap = F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(body), F.lit(0)))
    return F.concat(gap, body) if left else F.concat(body, gap)


def write_rows(batch: DataFrame, replacements: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """batch with the fields of the replaced rows, and whether a row was replaced."""
    new = replacements.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__hit"))
    both = batch.join(new, keys, "left")
    rest = [c for c in batch.columns if c not in fields]
    return both.select(*rest, *(F.when(F.col("__hit"), F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields), F.coalesce("__hit", F.lit(False)).alias("replaced"))


def fill_plan(groups: DataFrame, live: Column, order: str, needed: int) -> DataFrame:
    """The first `needed` live groups; if there are fewer, dead ones in order make up the rest."""
    return groups.withColumn("live", live).orderBy(F.desc("live"), order).limit(needed)


def dead_rows(rows: DataFrame, group: str, advantage: Column) -> DataFrame:
    """Rows of groups all of whose advantages are zero: what a replay replaces."""
    w = Window.partitionBy(group)
    return rows.withColumn("__dead", F.bool_and(advantage == 0).over(w)).where("__dead").drop("__dead")


def valid_rewards(rewards: Column, most: int = 256) -> Column:
    """Whether a map of reward names to numbers has printable names and finite numbers."""
    fine = lambda k, v: k.rlike(r"^(?:[^\p{C}\p{Z}]|\x20)+$") & (F.length(k) <= most) & (F.trim(k) != "") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.forall(F.map_entries(rewards), lambda e: fine(e["key"], e["value"]))


def mask_run(mask: Column) -> tuple[Column, Column, Column]:
    """Ones of a boolean mask, and whether they are one run at its start, or at its end."""
    n, size = F.size(F.filter(mask, lambda x: x)), F.size(mask)
    prefix = F.forall(F.transform(mask, lambda x, i: x == (i < n)), lambda ok: ok)
    suffix = F.forall(F.transform(mask, lambda x, i: x == (i >= size - n)), lambda ok: ok)
    return n, prefix, suffix


def clamp_logprobs(values: Column, most: float = 1e-3) -> tuple[Column, Column, Column]:
    """Log-probabilities with those just over 0 at 0, how many were, and whether one is larger than `most` or not finite."""
    over = F.size(F.filter(values, lambda x: (x > 0) & (x <= most)))
    bad = F.exists(values, lambda x: (x > most) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.transform(values, lambda x: F.when((x > 0) & (x <= most), F.lit(0).cast("float")).otherwise(x)), over, bad


def unpad(values: Column, n: Column, left: bool = False) -> Column:
    """The n values of a row that padding surrounds: its last ones when padded on the left, else its first."""
    return F.slice(values, F.size(values) - n + 1, n) if left else F.slice(values, F.lit(1), n)


def shard(rows: DataFrame, row: str, start: int, stop: int) -> DataFrame:
    """Rows start to stop (exclusive) of a batch."""
    return rows.where(F.col(row).between(start, stop - 1))


def union_shards(shards: list[DataFrame], values: str, fill) -> DataFrame:
    """Shards in rank order, with `rank`, the length n of each row's values, and values padded on the right to the widest of all."""
    every = None
    for rank, part in enumerate(shards):
        part = part.withColumn("rank", F.lit(rank)).withColumn("n", F.size(values))
        every = part if every is None else every.unionByName(part)
    width = every.agg(F.max("n").alias("__width"))  # one row
    return every.crossJoin(F.broadcast(width)).withColumn(values, F.concat(values, F.array_repeat(F.lit(fill).cast(every.schema[values].dataType.elementType), F.col("__width") - F.col("n")))).drop("__width")


def union_rounds(rounds: list[DataFrame]) -> DataFrame:
    """Generation rounds under one another with `round`; all must have the same columns."""
    first, every = rounds[0], None
    for i, part in enumerate(rounds):
        if set(part.columns) != set(first.columns):
            raise ValueError(f"round {i} has other columns: {sorted(set(part.columns) ^ set(first.columns))}")
        part = part.withColumn("round", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every


def linear_schedule(step: Column, start: float, end: float, total: int) -> Column:
    """From start to end in equal steps, then end."""
    return F.greatest(F.lit(end), F.lit(start) - (F.lit(start) - F.lit(end)) * step / total)


def miswritten(read: DataFrame, want: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows to be written that read back differently, or not at all."""
    new = read.select(*keys, F.struct(*fields).alias("__read"))
    both = want.withColumn("__want", F.struct(*fields)).join(new, keys, "left")
    return both.where(~F.col("__read").eqNullSafe(F.col("__want"))).drop("__read", "__want")
