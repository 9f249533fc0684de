"""Verification of an attested log: each check is a join or a window, its result the violations (ord, problem)."""

from __future__ import annotations

from collections.abc import Collection
from fractions import Fraction
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions import exact as X
from embertide.functions.decay import Decay, expired
from embertide.functions.staleness import decision_problem_udf
from embertide.operators import replay as R
from embertide.operators.scan import Span, ranked, running_sum, running_sums, span_of
from embertide.session import cut
from embertide.sources.logs import log_violations

#: Why an entry may leave, and the lengths of texts.
REASONS = ("stale", "capacity", "explicit", "quarantine", "drift", "age")
DIGEST, SOURCE_CHARS, PREDICATE_CHARS = "^[0-9a-f]{64}$", 256, 1024
#: Most draws of a sample and rows of a batch.
MOST = 1 << 20


def problems(df: DataFrame, **checks: Column) -> DataFrame:
    """(ord, problem) for each check that is true; a null check is no problem."""
    told = F.array(*(F.when(bad, F.lit(name.replace("_", " "))) for name, bad in checks.items()))
    return df.select("ord", F.explode(F.filter(told, lambda p: p.isNotNull())).alias("problem"))


def printable(text: Column, most: int) -> Column:
    """Whether a text has 1 to `most` characters, none of them a control or separator but the space, and not only spaces."""
    return text.rlike(r"^(?:[^\p{C}\p{Z}]|\x20)+$") & (F.length(text) <= most) & (F.trim(text) != "")


def config(log: DataFrame) -> tuple[Decay, dict]:
    """The buffer's parameters and the draw parameters from the first record."""
    row = log.where("ord = 1 and op = 'decay_config'").first()
    if row is None:
        raise ValueError("the log doesn't start with its configuration")
    decay = Decay(int(row["half_life"]), int(row["max_policy_age"]), int(row["capacity"]), int(row["rebase_slack"] or 0))
    draw = {} if row["seed"] is None else {"seed": int(row["seed"]), "buffer_id": int(row["buffer_id"]), "beta": float.fromhex(row["beta"])}
    return decay, draw | {"reset": row["reset_age_on_update"] == "true", "min_entry_age": row["min_entry_age"], "format": row["format"]}


def mutation_problems(moved: DataFrame, decay: Decay, reset: bool = False) -> DataFrame:
    """Each mutation against what its slot held: old and new leaf, version, epoch, reason and liveness."""
    op, reason = F.col("op"), F.col("reason")
    evict, live = op == "evict", F.col("live")
    old = expired(F.col("t"), F.col("version"), decay.max_age)
    same = (F.col("prev_q") == F.col("q")) & (F.col("prev_t") == F.col("t"))
    stamp = F.col("version") if reset else F.col("prev_t")
    oldest = R.least_live(R.lifetimes(moved), F.col("t"), moved.where("op = 'evict' and reason = 'capacity'").select("ord", "t"), "oldest")
    quarantine = reason.eqNullSafe("quarantine")
    texts = F.coalesce(printable(F.col("predicate"), PREDICATE_CHARS) & printable(F.col("note"), SOURCE_CHARS), F.lit(False))
    rows = problems(
        moved,
        slot_out_of_range=~F.coalesce(F.col("slot").between(0, decay.capacity - 1), F.lit(False)),
        old_value=~F.col("old").eqNullSafe(F.col("want_old")),
        new_value=~F.col("new").eqNullSafe(F.col("want_new")),
        base_epoch=~F.col("base").eqNullSafe(F.col("epoch")),
        entry_version_is_newer=F.col("t") > F.col("version"),
        insert_into_a_live_slot=(op == "insert") & live,
        update_of_an_empty_slot=(op == "update") & ~live,
        evict_of_an_empty_slot=evict & ~live,
        evict_names_another_entry=evict & live & ~F.coalesce(same, F.lit(False)),
        expired_entry_written=~evict & old,
        update_changes_version=(op == "update") & live & (F.col("t") != stamp),
        reason_unknown=evict & ~F.coalesce(reason.isin(*REASONS), F.lit(False)),
        reason_without_evict=~evict & reason.isNotNull(),
        stale_evict_of_a_fresh_entry=evict & (reason == "stale") & ~old,
        quarantine_texts=F.when(quarantine, ~texts).otherwise(F.col("predicate").isNotNull() | F.col("note").isNotNull()),
    )
    return rows.unionByName(problems(oldest, capacity_evict_of_a_newer_entry=F.col("t") > F.col("oldest")))


def protocol_problems(clocked: DataFrame, moved: DataFrame, decay: Decay, truncated: bool = False, span: Span | None = None) -> DataFrame:
    """Version advances, stale entries that outstay, rebases that are due, and runs of capacity evictions that weren't needed."""
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    moves = clocked.where("op = 'advance_version'").withColumns({"old_v": whole("old_version"), "new_v": whole("new_version")})
    out = problems(moves, version_runs_back=F.col("new_v") < F.col("old_v"), old_version=F.col("old_v") != F.col("version") - (F.col("new_v") - F.col("old_v")))
    # when a version was reached: gaps between versions are filled
    reached = moves.where("new_v > old_v").select(F.explode(F.sequence(F.col("old_v") + 1, F.col("new_v"))).alias("v"), F.col("ord").alias("at"), F.col("others").alias("others_then"))
    held = moved.where("op <> 'evict'").select("ord", "next_ord", "next_op", (F.col("t") + decay.max_age + 1).alias("v"))
    held = held.join(reached, "v").where("at > ord and (next_ord is null or at < next_ord)")
    ends = clocked.select(F.col("ord").alias("next_ord"), F.col("others").alias("others_end"), F.when(F.col("op").isin(*R.MUTATIONS) & ~F.col("reason").eqNullSafe("stale"), 1).otherwise(0).alias("own"))
    last = clocked.agg(F.max("others").alias("others_last"))  # one row
    held = held.join(ends, "next_ord", "left").crossJoin(F.broadcast(last))
    passed = F.coalesce(F.col("others_end") - F.col("own"), F.col("others_last")) - F.col("others_then")
    late = (passed > 0) | (F.col("own") == 1) | (F.lit(not truncated) & F.col("next_ord").isNull())
    out = out.unionByName(held.where(F.coalesce(late, F.lit(False))).select("ord", F.lit("expired entry outstays").alias("problem")))

    due = F.floor(F.col("version") / decay.half_life) - F.col("epoch") > decay.max_shift
    waiting = F.col("op").isin("rebase", "advance_version") | F.col("op").eqNullSafe("evict") & F.col("reason").eqNullSafe("stale")
    out = out.unionByName(problems(clocked, rebase_is_due=due & ~waiting))
    total = live_totals(clocked, moved, span).where("op = 'rebase'")
    base = F.floor(F.greatest(F.lit(0), F.col("version") - decay.max_age) / decay.half_life)
    old_e, new_e = whole("old_base_epoch"), whole("new_base_epoch")
    was = F.floor(F.col("version") / decay.half_life) - old_e > decay.max_shift
    rebase = problems(
        total,
        rebase_is_not_due=~was,
        rebase_epochs=(new_e != base) | (new_e <= old_e) | (F.col("epoch") - (new_e - old_e) != old_e),
        rebase_total_after=F.expr(f"try_cast(root_total_after as {R.WIDE})") != F.col("total"),
        rebase_total_before=F.expr(f"try_cast(root_total_before as {R.WIDE})") != (F.col("total") * _power(new_e - old_e)).cast(R.WIDE),
    )
    return out.unionByName(rebase).unionByName(capacity_run_problems(clocked, moved, decay, span))


def _power(n: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << k).cast("decimal(20,0)") for k in range(63))), n.cast("int"))


def live_totals(clocked: DataFrame, moved: DataFrame, span: Span | None = None) -> DataFrame:
    """clocked with the live set after each record: total (of leaves at its epoch) and entries."""
    sums = moved.select("ord", "change0", "entries")
    rows = clocked.join(sums, "ord", "left").fillna(0, ["entries"]).withColumn("change0", F.coalesce("change0", F.lit(0).cast(R.WIDE)))
    rows = running_sums(rows, "ord", {"total0": (F.col("change0"), R.WIDE), "live_entries": (F.col("entries"), "bigint")}, span=span)
    return rows.withColumn("total", (F.col("total0") / _power(F.col("epoch"))).cast(R.WIDE))


def capacity_run_problems(clocked: DataFrame, moved: DataFrame, decay: Decay, span: Span | None = None) -> DataFrame:
    """A run of capacity evicts must be followed by exactly as many inserts as it and the free slots before it make room for."""
    live = live_totals(clocked, moved, span).select("ord", "op", "reason", "live_entries")
    capacity = F.col("op").eqNullSafe("evict") & F.col("reason").eqNullSafe("capacity")
    rows = ranked(live, "ord", "nth", span=span).withColumn("kind", F.when(capacity, "c").when(F.col("op") == "insert", "i").otherwise("x"))
    before = rows.select((F.col("nth") + 1).alias("nth"), F.col("kind").alias("before"), F.col("live_entries").alias("live_before"))
    rows = rows.join(before, "nth", "left")
    turn = (F.col("kind") != F.coalesce("before", F.lit("x"))).cast("int")
    rows = running_sum(rows, "ord", turn, "run", kind="bigint", span=span)
    runs = rows.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min_by("live_before", "ord").alias("live_before"))
    after = runs.where("kind = 'i'").select((F.col("run") - 1).alias("run"), F.col("n").alias("inserts"))
    evicts = runs.where("kind = 'c'").join(after, "run", "left")
    slots = 1 << (decay.capacity - 1).bit_length()
    return problems(evicts, capacity_evicts_were_not_needed=~F.col("inserts").eqNullSafe(F.lit(slots) - F.col("live_before") + F.col("n")))


def sample_state(clocked: DataFrame, moved: DataFrame, span: Span | None = None) -> DataFrame:
    """Each draw with the state it was made in: total, live_entries, the entry of its slot, its interval lo .. hi, the least positive leaf."""
    totals = live_totals(clocked, moved, span).where("op = 'sample'").select("ord", "total", "total0", "live_entries")
    least = R.least_live(R.lifetimes(moved), F.when(F.col("leaf0") > 0, F.col("leaf0")), totals, "least0", span)
    drawn = R.occupant(moved, R.draws_of(clocked))
    drawn = R.sums_below(moved, drawn, span).join(least, "ord")
    unit = _power(F.col("epoch"))
    leaf = F.coalesce((F.col("held_leaf0") / unit).cast(R.WIDE), F.lit(0).cast(R.WIDE))
    rows = drawn.withColumns({"lo": (F.col("below") / unit).cast(R.WIDE), "leaf": leaf, "least": (F.col("least0") / unit).cast(R.WIDE)})
    return rows.withColumn("hi", (F.col("lo") + F.col("leaf")).cast(R.WIDE))


def _fraction_problem(leaf, total, pn, pd_, wn, wd) -> str | None:
    try:
        prob, w = Fraction(int(pn), int(pd_)), Fraction(int(wn), int(wd))
    except (ValueError, TypeError, ZeroDivisionError):
        return "malformed fraction"
    if prob != Fraction(int(leaf), int(total)) or gcd(int(pn), int(pd_)) != 1:
        return "probability"
    if not 0 < w <= 1 or gcd(int(wn), int(wd)) != 1:
        return "weight out of range"
    return None


@F.pandas_udf(T.StringType())
def _fractions(leaf: pd.Series, total: pd.Series, pn: pd.Series, pd_: pd.Series, wn: pd.Series, wd: pd.Series) -> pd.Series:
    return pd.Series([_fraction_problem(*x) if x[1] else "empty total" for x in zip(leaf, total, pn, pd_, wn, wd, strict=True)], dtype=object)


def _drawn(seed: int, buffer_id: int, beta: float, domain: bytes):
    """Whether a draw is the keyed one and its weight the formula's, each power within one ulp."""

    def one(total, draw, counter, n, leaf, least, wn, wd) -> str | None:
        if draw is None or not 0 < total < 1 << 64 or int(draw) != X.keyed_draw(int(total), seed, buffer_id, int(counter), domain):
            return "not the keyed draw"
        if least is None or not leaf or not (wn or "").isdigit() or not (wd or "").isdigit() or not int(wd):
            return None
        same = X.weight_within_one_ulp(Fraction(int(wn), int(wd)), int(n), int(leaf), int(least), int(total), beta)
        return None if same else "not the formula's weight"

    @F.pandas_udf(T.StringType())
    def check(total: pd.Series, draw: pd.Series, counter: pd.Series, n: pd.Series, leaf: pd.Series, least: pd.Series, wn: pd.Series, wd: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(total, draw, counter, n, leaf, least, wn, wd, strict=True)], dtype=object)

    return check


def sample_problems(state: DataFrame, draw: dict, domain: bytes = X.DRAW) -> DataFrame:
    """Each draw against the replayed live set, and, where the log tells its seed, against the keyed draw and the weight formula."""
    out = problems(
        state,
        root_total=~F.col("root_total").eqNullSafe(F.col("total")),
        draw_out_of_range=~F.coalesce((F.col("draw") >= 0) & (F.col("draw") < F.col("total")), F.lit(False)),
        draw_is_not_in_its_slot=~F.coalesce((F.col("lo") <= F.col("draw")) & (F.col("draw") < F.col("hi")), F.lit(False)),
        entry_version_of_a_draw=F.col("declared_t").isNotNull() & ~F.col("declared_t").eqNullSafe(F.col("held_t")),
        entry_is_too_young=(F.col("version") - F.col("held_t")) < (int(draw["min_entry_age"]) if draw.get("min_entry_age") else 0),
        too_many_draws=F.col("k") >= MOST,
    )
    told = state.withColumn("problem", _fractions("leaf", "total", "prob_num", "prob_den", "w_num", "w_den")).where("problem is not null").select("ord", "problem")
    out = out.unionByName(told)
    if "seed" in draw:
        keyed = _drawn(draw["seed"], draw["buffer_id"], draw["beta"], domain)("total", "draw", "counter", "live_entries", "leaf", "least", "w_num", "w_den")
        out = out.unionByName(state.withColumn("problem", keyed).where("problem is not null").select("ord", "problem"))
    return out.distinct()


def content_problems(clocked: DataFrame, moved: DataFrame, drawn: DataFrame) -> DataFrame:
    """Digests and sources of mutations, and batch witnesses against the draws they place."""
    digest, source, insert = F.col("content_digest"), F.col("source"), F.col("op") == "insert"
    style = moved.where("op = 'insert'").agg(F.min_by(digest.isNotNull(), "ord").alias("with_digest"))  # one row
    out = problems(
        moved.crossJoin(F.broadcast(style)),
        digest_shape=~digest.rlike(DIGEST),
        digest_off_an_insert=digest.isNotNull() & ~insert,
        source_without_digest=source.isNotNull() & digest.isNull(),
        source_shape=~printable(source, SOURCE_CHARS),
        some_inserts_lack_a_digest=insert & (digest.isNotNull() != F.col("with_digest")),
    )
    samples = clocked.where("op = 'sample'").select(F.col("samples_so_far"), F.col("ord").alias("sample_ord"), F.col("op_counter").alias("sample_op"), F.size("samples").alias("n"))
    behind = samples.select((F.col("samples_so_far") + 1).alias("samples_so_far"), F.col("sample_op").alias("before"))
    order = samples.join(behind, "samples_so_far").withColumnRenamed("sample_ord", "ord")
    out = out.unionByName(problems(order, sample_counter_does_not_grow=F.col("sample_op").cast("bigint") <= F.col("before").cast("bigint")))

    batches = clocked.where("op = 'batch'").join(samples, "samples_so_far", "left").withColumn("rows", F.expr("try_cast(batch_rows as bigint)"))
    twice = Window.partitionBy("sample_op_counter").orderBy("ord")
    batches = batches.withColumn("nth", F.row_number().over(twice))
    declined = F.coalesce("declined", F.array().cast("array<string>"))
    out = out.unionByName(problems(
        batches,
        witness_names_another_sample=~F.col("sample_op_counter").eqNullSafe(F.col("sample_op")),
        sample_is_witnessed_twice=F.col("nth") > 1,
        witness_does_not_cover_its_draws=F.size("replaced") + F.size(declined) != F.col("n"),
        tensor_digest_shape=~F.coalesce(F.col("tensor_digest").rlike(DIGEST), F.lit(False)),
        batch_rows=~F.coalesce(F.col("rows").between(1, MOST), F.lit(False)),
    ))
    placed = R.placed_rows(clocked)
    gone = clocked.where("op = 'batch'").select("ord", F.col("sample_op_counter").alias("sample_op"), F.explode(F.transform(declined, lambda d: d.cast("int"))).alias("k"))
    told = placed.select("ord", "k").unionByName(gone.select("ord", "k"))
    out = out.unionByName(told.groupBy("ord", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ord", F.lit("draw is told twice").alias("problem")))
    out = out.unionByName(placed.groupBy("ord", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ord", F.lit("row is replaced twice").alias("problem")))
    met = placed.join(drawn.select("sample_op", "k", "held_digest"), ["sample_op", "k"], "left")
    out = out.unionByName(problems(
        met,
        row_outside_the_batch=~F.coalesce((F.col("row") >= 0) & (F.col("row") < F.col("batch_rows")), F.lit(False)),
        row_claims_another_example=~F.coalesce(F.col("content_digest") == F.col("held_digest"), F.lit(False)),
    ))
    return out.distinct()


def manifest_problems(moved: DataFrame, manifest: DataFrame) -> DataFrame:
    """The i-th line must open the i-th insert with a digest: its counter, slot, digest, source and version; ord is that of the line or insert."""
    inserts = ranked(moved.where("op = 'insert' and content_digest is not null"), "ord", "nth")
    inserts = inserts.select("nth", F.col("ord").alias("insert_ord"), F.col("op_counter").alias("c"), "slot", F.col("content_digest").alias("d"), F.col("source").alias("s"), "t")
    lines = ranked(manifest, "ord", "nth")
    fields = X.content_digest_hex_udf("prompt_id", "tokens", F.col("reward_hex"))
    both = lines.withColumn("opened", fields).join(inserts, "nth", "full").withColumn("ord", F.coalesce("insert_ord", "ord"))
    missing = F.col("d").isNull() | F.col("content_digest").isNull()
    return problems(
        both,
        manifest_and_inserts_differ_in_number=missing,
        manifest_digest_does_not_open=~missing & ~F.coalesce(F.col("opened") == F.col("content_digest"), F.lit(False)),
        manifest_line_of_another_insert=~missing & ((F.col("op_counter").cast("string") != F.col("c")) | (F.col("index") != F.col("slot")) | (F.col("content_digest") != F.col("d"))),
        manifest_source=~missing & ~F.col("source").eqNullSafe(F.col("s")),
        manifest_version=~missing & (F.col("entry_version").cast("bigint") != F.col("t")),
    )


@F.pandas_udf(T.StringType())
def _ess(nums: pd.Series, dens: pd.Series) -> pd.Series:
    """Effective size of a sample's weights as num/den."""


    def one(ns, ds) -> str | None:
        if ns is None or any(int(d) == 0 for d in ds):
            return None
        size = X.effective_size([Fraction(int(a), int(b)) for a, b in zip(ns, ds, strict=True)])
        return f"{size.numerator}/{size.denominator}"

    return pd.Series([one(*x) for x in zip(nums, dens, strict=True)], dtype=object)


def telemetry_problems(clocked: DataFrame, moved: DataFrame, drawn: DataFrame) -> DataFrame:
    """Telemetry against the sample and witness it names: counts, effective size, ages, slots that still hold what was drawn, a fixed policy.

    A sample is no larger than MOST draws, so its weights meet in one row.
    """
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    points = clocked.where("op = 'telemetry'").withColumns({c: whole(c) for c in ("batch_rows", "replaced_rows", "declined_rows", "staleness_max", "staleness_sum")})
    out = problems(
        points,
        more_rows_than_the_batch=F.col("replaced_rows") + F.col("declined_rows") > F.col("batch_rows"),
        rows_without_a_sample=F.col("sample_op_counter").isNull() & (F.col("replaced_rows") + F.col("declined_rows") > 0),
        reported_is_not_sorted=~F.col("reported").eqNullSafe(F.array_sort(F.array_distinct("reported"))),
    )
    named = points.where("sample_op_counter is not null").withColumn("nth", F.row_number().over(Window.partitionBy("sample_op_counter").orderBy("ord")))
    per = drawn.groupBy("sample_op", "samples_so_far").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("k", "w_num", "w_den"))).alias("ws"))
    named = named.join(per.drop("samples_so_far").withColumnRenamed("sample_op", "sample_op_counter"), "sample_op_counter", "left")
    latest = per.select("samples_so_far", F.col("sample_op").alias("latest"))
    named = named.join(latest, "samples_so_far", "left")
    ess = _ess(F.col("ws.w_num"), F.col("ws.w_den"))
    named = named.withColumn("size", F.when(F.col("ws").isNotNull(), ess))
    reduced = F.concat_ws("/", "ess_num", "ess_den")
    out = out.unionByName(problems(
        named,
        telemetry_names_another_sample=~F.col("sample_op_counter").eqNullSafe(F.col("latest")),
        telemetry_twice=F.col("nth") > 1,
        rows_are_not_the_draws=F.col("replaced_rows") + F.col("declined_rows") != F.col("n"),
        effective_size=F.col("size") != reduced,
    ))
    probes = named.select("ord", "version", F.col("sample_op_counter").alias("sample_op"), "staleness_max", "staleness_sum").join(
        drawn.select("sample_op", "k", "slot", F.col("inserted").alias("drawn_insert")), "sample_op")
    now = R.occupant(moved, probes)
    out = out.unionByName(problems(now, slot_no_longer_holds_the_draw=~F.col("inserted").eqNullSafe(F.col("drawn_insert"))).distinct())
    ages = now.withColumn("age", F.col("version") - F.col("held_t")).groupBy("ord", "staleness_max", "staleness_sum").agg(F.max("age").alias("most"), F.sum("age").alias("sum"))
    out = out.unionByName(problems(ages, staleness=(F.col("staleness_max") != F.col("most")) | (F.col("staleness_sum") != F.col("sum"))))

    aged = now.withColumn("age", F.col("version") - F.col("held_t")).select("ord", "k", "age")
    aged = aged.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "age"))), lambda a: a.age).alias("ages"))
    decided = named.where("policy is not null or decisions is not null").join(aged, "ord")
    out = out.unionByName(problems(decided, policy_without_decisions=F.col("policy").isNull() != F.col("decisions").isNull(), policy_without_log_ratios=F.col("log_ratios").isNull()))
    spelled = F.to_json("decisions", {"ignoreNullFields": "false"})
    told = decided.withColumn("problem", decision_problem_udf("policy", "log_ratios", "ws.w_num", "ws.w_den", "ages", spelled))
    out = out.unionByName(told.where("problem is not null").select("ord", "problem"))
    kept = F.size(F.filter("decisions", lambda d: d.reason.isNull()))
    out = out.unionByName(problems(decided, decisions_disagree_with_the_counts=(kept != F.col("replaced_rows")) | (F.size("decisions") - kept != F.col("declined_rows"))))

    witness = clocked.where("op = 'batch'").select(
        "sample_op_counter", F.col("ord").alias("w_ord"), F.col("step").alias("w_step"), whole("batch_rows").alias("w_rows"), F.size("replaced").cast("bigint").alias("w_replaced"),
        F.size(F.coalesce("declined", F.array().cast("array<string>"))).cast("bigint").alias("w_declined"))
    any_witness = witness.agg(F.min("w_ord").alias("first_witness"))  # one row
    both = named.join(witness, "sample_op_counter", "left").crossJoin(F.broadcast(any_witness))
    differ = (F.col("w_step") != F.col("step")) | (F.col("w_rows") != F.col("batch_rows")) | (F.col("w_replaced") != F.col("replaced_rows")) | (F.col("w_declined") != F.col("declined_rows"))
    out = out.unionByName(problems(both, telemetry_disagrees_with_its_witness=differ, sample_has_no_witness=F.col("w_ord").isNull() & F.col("first_witness").isNotNull()))
    told = named.where("policy is not null").agg(F.min_by("policy", "ord").alias("first_policy"), F.min("ord").alias("since"))  # one row
    kept = named.crossJoin(F.broadcast(told))
    out = out.unionByName(problems(kept, policy_changes=(F.col("ord") > F.col("since")) & ~F.col("policy").eqNullSafe(F.col("first_policy"))))
    ratios = named.where("log_ratios is not null").agg(F.min("ord").alias("since"))  # one row
    dropped = named.crossJoin(F.broadcast(ratios))
    return out.unionByName(problems(dropped, log_ratios_are_left_out=(F.col("ord") > F.col("since")) & F.col("log_ratios").isNull(), log_ratios_are_not_the_draws=F.size("log_ratios") != F.col("n")))


def abandoned_problems(clocked: DataFrame, form: str | None, truncated: bool = False) -> DataFrame:
    """In format 4 a sample has a witness and telemetry, unless the next one is at the same version or an earlier one (the writer died)."""
    if form != "4":
        return clocked.limit(0).select("ord", F.lit("").alias("problem"))
    samples = clocked.where("op = 'sample'").select("ord", "samples_so_far", "version", F.col("op_counter").alias("sample_op"))
    after = samples.select((F.col("samples_so_far") - 1).alias("samples_so_far"), F.col("version").alias("next_version"))
    told = lambda op: clocked.where(F.col("op") == op).select(F.col("sample_op_counter").alias("sample_op")).distinct().withColumn(op, F.lit(True))
    rows = samples.join(after, "samples_so_far", "left").join(told("batch"), "sample_op", "left").join(told("telemetry"), "sample_op", "left")
    left = F.coalesce(F.col("next_version") <= F.col("version"), F.lit(truncated))
    return problems(rows, sample_lacks_a_witness=F.col("batch").isNull() & ~left, sample_lacks_telemetry=F.col("telemetry").isNull() & ~left)


CHECKS = ("chain", "mutations", "protocol", "samples", "content", "telemetry", "abandoned")


def verify_log(log: DataFrame, manifest: DataFrame | None = None, truncated: bool = False, domain: bytes = X.DRAW, only: Collection[str] = CHECKS) -> DataFrame:
    """Violations (ord, problem) of a log read by read_log, by the checks named; none from all of them means that it verifies.

    truncated: the writer may have died at the end. manifest: must open exactly the log's inserts. domain: that of the writer's draws.
    """
    decay, draw = config(log)
    span = span_of(log, "ord")
    clocked = cut(R.clock(log, span), "clock")
    moved = cut(R.mutations(clocked, decay), "mutations")
    drawn = {"samples", "content", "telemetry"} & set(only)
    state = cut(sample_state(clocked, moved, span), "draws") if drawn else None
    make = {
        "chain": lambda: log_violations(log),
        "mutations": lambda: mutation_problems(moved, decay, draw["reset"]),
        "protocol": lambda: protocol_problems(clocked, moved, decay, truncated, span),
        "samples": lambda: sample_problems(state, draw, domain),
        "content": lambda: content_problems(clocked, moved, state),
        "telemetry": lambda: telemetry_problems(clocked, moved, state),
        "abandoned": lambda: abandoned_problems(clocked, draw["format"], truncated),
    }
    parts = [make[name]() for name in only]
    if manifest is not None:
        parts.append(manifest_problems(moved, manifest))
    out = parts[0].select("ord", "problem")
    for part in parts[1:]:
        out = out.unionByName(part.select("ord", "problem"))
    return out.distinct()


def explain_rows(log: DataFrame, asked: DataFrame) -> DataFrame:
    """Why rows (step, row) of a batch hold what they hold: kind replayed, with the draw, example and inserts behind it, or fresh.

    A step that is witnessed more than once gives a row for each witness; a row outside its batch gives none.
    """
    decay, _ = config(log)
    clocked = cut(R.clock(log), "clock")
    moved = R.mutations(clocked, decay)
    witnesses = clocked.where("op = 'batch'").select(F.expr("try_cast(step as bigint)").alias("step"), F.col("sample_op_counter").alias("sample_op"), F.expr("try_cast(batch_rows as bigint)").alias("batch_rows"))
    rows = asked.join(witnesses, "step").where("row >= 0 and row < batch_rows")
    hit = rows.join(R.placed_rows(clocked).select("step", "row", "sample_op", "k", "content_digest"), ["step", "row", "sample_op"], "left")
    drawn = R.occupant(moved, R.draws_of(clocked)).select("sample_op", "k", "slot", F.col("held_source").alias("source"), "w_num", "w_den")
    hit = hit.join(drawn, ["sample_op", "k"], "left")
    stored = moved.where("op = 'insert' and content_digest is not null").groupBy("content_digest").agg(F.sort_array(F.collect_list("ord")).alias("stored_at"), F.sort_array(F.collect_list("t")).alias("versions"))
    hit = hit.join(stored, "content_digest", "left")
    return hit.withColumn("kind", F.when(F.col("k").isNull(), "fresh").otherwise("replayed")).select(
        "step", "row", "sample_op", "kind", F.col("k").alias("draw"), "content_digest", "source", "slot", "w_num", "w_den", "stored_at", "versions")
