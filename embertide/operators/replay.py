"""Replay of an attested log as joins: who held a slot when, what the live set summed to, what it held least.

A log is a table with a unique `ord`. Nothing here walks it record by record: running values come from scans in levels,
sums over slots from dyadic nodes of the slots, least values over the live set from dyadic nodes of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions.decay import Decay, leaf
from embertide.operators.scan import Span, running_sum, running_sums, span_of

WIDE = "decimal(38,0)"
#: Bits of a slot number and of an order.
SLOT_BITS, ORDER_BITS = 32, 40
MUTATIONS = ("insert", "update", "evict")


def clock(log: DataFrame, span: Span | None = None) -> DataFrame:
    """log with the buffer's state after each record: version, epoch, samples so far, draws before it, other records so far.

    Numbers of the log are text of digits. A record counts as other unless it is a stale evict, a rebase or a version advance.
    """
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))
    op = F.col("op")
    stale = op.eqNullSafe("evict") & F.col("reason").eqNullSafe("stale")
    drawn = F.when(op == "sample", F.size(F.coalesce("samples", F.array()))).otherwise(0)
    running = (
        ("version", F.when(op == "advance_version", number("new_version") - number("old_version")).otherwise(0)),
        ("epoch", F.when(op == "rebase", number("new_base_epoch") - number("old_base_epoch")).otherwise(0)),
        ("samples_so_far", F.when(op == "sample", 1).otherwise(0)),
        ("draws_before", drawn),
        ("others", F.when(stale | op.isin("rebase", "advance_version", "decay_config"), 0).otherwise(1)),
    )
    span = span or span_of(log, "ord")
    log = running_sums(log, "ord", {name: (change, "bigint") for name, change in running}, span=span)
    return log.withColumn("draws_before", F.col("draws_before") - drawn)


def mutations(clocked: DataFrame, decay: Decay) -> DataFrame:
    """Mutation records with what their slot held before (live, prev_q, prev_t, prev_ord) and the leaf that had at this epoch.

    leaf0 and change0 are the new leaf and its change in units of epoch 0, in which a rebase changes nothing.
    """
    rows = clocked.where(F.col("op").isin(*MUTATIONS)).select(
        "ord", "op", "reason", "predicate", "note", "content_digest", "source", "version", "epoch", "others", "op_counter",
        *(F.expr(f"try_cast({c} as bigint)").alias(a) for c, a in (("index", "slot"), ("base_priority_int", "q"), ("entry_version", "t"), ("base_epoch", "base"))),
        *(F.expr(f"try_cast({c} as {WIDE})").alias(a) for c, a in (("old_priority_int", "old"), ("new_priority_int", "new"))),
    )
    w = Window.partitionBy("slot").orderBy("ord")
    rows = rows.withColumns({
        "prev_op": F.lag("op").over(w), "prev_q": F.lag("q").over(w), "prev_t": F.lag("t").over(w), "next_ord": F.lead("ord").over(w), "next_op": F.lead("op").over(w),
    })
    rows = rows.withColumn("live", F.coalesce(F.col("prev_op").isin("insert", "update"), F.lit(False)))
    before = F.when(F.col("live"), leaf(F.col("prev_q"), F.col("prev_t"), F.col("epoch"), decay.half_life)).otherwise(0).cast(WIDE)
    own = F.when(F.col("op") == "evict", 0).otherwise(leaf(F.col("q"), F.col("t"), F.col("epoch"), decay.half_life)).cast(WIDE)
    scale = F.get(F.array(*(F.lit(1 << k).cast("decimal(20,0)") for k in range(63))), F.col("epoch").cast("int"))
    rows = rows.withColumns({"want_old": before, "want_new": own})
    return rows.withColumns({
        "leaf0": (F.col("want_new") * scale).cast(WIDE), "change0": ((F.col("want_new") - F.col("want_old")) * scale).cast(WIDE),
        "entries": F.when((F.col("op") == "insert") & ~F.col("live"), 1).when((F.col("op") == "evict") & F.col("live"), -1).otherwise(0),
    })


def lifetimes(moved: DataFrame) -> DataFrame:
    """States of entries: slot, q, t, leaf0 held from start to before stop (null: still live)."""
    return moved.where("op <> 'evict'").select("slot", "q", "t", "leaf0", F.col("ord").alias("start"), F.col("next_ord").alias("stop"))


def sums_below(moved: DataFrame, probes: DataFrame, span: Span | None = None) -> DataFrame:
    """probes (ord, slot) with `below`, the sum of change0 over smaller slots and smaller ords.

    A slot's prefix is one node for each set bit of its number, so a probe meets at most SLOT_BITS running sums,
    each of a node's own changes; a change counts in one node for each unset bit.
    """
    part = lambda c: F.expr(f"shiftright({c}, level)")
    spread = lambda df, c: df.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.length(F.bin(c)), F.lit(SLOT_BITS)) - 1)))
    # nodes beyond the largest slot in use hold nothing that is asked for
    top = F.broadcast(probes.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("top")))  # one row
    changes = spread(moved.select("ord", "slot", "change0").crossJoin(top), "top").where("shiftright(top, level) > 0 and shiftright(slot, level) % 2 = 0")
    changes = changes.select("level", part("slot").alias("node"), "ord", F.lit(None).cast("long").alias("slot"), "change0")
    asked = spread(probes.select("ord", "slot").distinct(), "slot").where("shiftright(slot, level) % 2 = 1")
    asked = asked.select("level", (part("slot") - 1).alias("node"), "ord", "slot", F.lit(0).cast(WIDE).alias("change0"))
    both = running_sum(changes.unionByName(asked), "ord", F.col("change0"), "upto", keys=["level", "node"], span=span)
    found = both.where("slot is not null").groupBy("ord", "slot").agg(F.sum("upto").cast(WIDE).alias("below"))
    return probes.join(found, ["ord", "slot"], "left").withColumn("below", F.coalesce("below", F.lit(0).cast(WIDE)))


def least_live(states: DataFrame, value: Column, probes: DataFrame, out: str, span: Span | None = None) -> DataFrame:
    """probes (ord) with `out`, the least value of the states that hold at ord (null if none).

    A state covers the dyadic nodes of its span of orders, at most two for each level; a probe asks for the node of each
    level above it. So live entries and probes never meet pairwise. span: that of the log, whose greatest order bounds the levels.
    """
    end = 1 << (ORDER_BITS - 1) if span is None or span[2] is None else span[2] + 1
    stop = F.coalesce("stop", F.lit(end).cast("long"))
    spans = states.select(value.alias("x"), (F.col("start") + 1).alias("a"), stop.alias("b")).where("x is not null and a < b")
    spans = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("b") - F.col("a"))) - 1)))
    spans = spans.withColumns({"lo": F.expr("shiftright(a + shiftleft(1L, level) - 1, level)"), "hi": F.expr("shiftright(b, level)")}).where("lo < hi")
    nodes = F.filter(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)), lambda n: n.isNotNull())
    held = spans.select("level", F.explode(nodes).alias("node"), "x").groupBy("level", "node").agg(F.min("x").alias("x"))
    asked = probes.select("ord").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(end.bit_length() - 1))))
    asked = asked.withColumn("node", F.expr("shiftright(ord, level)"))
    found = asked.join(held, ["level", "node"]).groupBy("ord").agg(F.min("x").alias(out))
    return probes.join(found, "ord", "left")


def occupant(moved: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (ord, slot, ...) with the state of their slot before ord: held_ord, held_q, held_t, held_leaf0 and the insert's inserted, held_digest, held_source.

    All null where the slot was empty. One window over a slot's own records.
    """
    state = F.struct("ord", "op", "q", "t", "leaf0")
    first = F.struct("ord", F.col("content_digest").alias("digest"), "source")
    rows = moved.select("slot", "ord", state.alias("__s"), F.when(F.col("op") == "insert", first).alias("__i"), F.lit(None).cast(_row_type(probes)).alias("__p"))
    asked = probes.select("slot", "ord", F.lit(None).cast(rows.schema["__s"].dataType).alias("__s"), F.lit(None).cast(rows.schema["__i"].dataType).alias("__i"), F.struct(*probes.columns).alias("__p"))
    w = Window.partitionBy("slot").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(asked).withColumns({"__ls": F.last("__s", ignorenulls=True).over(w), "__li": F.last("__i", ignorenulls=True).over(w)})
    held = F.coalesce(F.col("__ls.op") != "evict", F.lit(False))
    pick = lambda c: F.when(held, F.col(c))
    return both.where("__p is not null").select(
        "__p.*", pick("__ls.ord").alias("held_ord"), pick("__ls.q").alias("held_q"), pick("__ls.t").alias("held_t"), pick("__ls.leaf0").alias("held_leaf0"),
        pick("__li.ord").alias("inserted"), pick("__li.digest").alias("held_digest"), pick("__li.source").alias("held_source"),
    )


def _row_type(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType


def draws_of(clocked: DataFrame) -> DataFrame:
    """One row for each draw of each sample record: ord, sample_op, k, counter, slot and the declared numbers."""
    rows = clocked.where("op = 'sample'").select("ord", F.col("op_counter").alias("sample_op"), "root_total", "version", "epoch", "draws_before", "samples_so_far", F.posexplode("samples").alias("k", "d"))
    big = lambda c: F.expr(f"try_cast({c} as {WIDE})")
    return rows.select(
        "ord", "sample_op", "k", (F.col("draws_before") + F.col("k")).alias("counter"), F.expr("try_cast(d.leaf_index as bigint)").alias("slot"), big("d.draw_int").alias("draw"),
        big("root_total").alias("root_total"), "version", "epoch", "samples_so_far", F.col("d.prob_num").alias("prob_num"), F.col("d.prob_den").alias("prob_den"),
        F.col("d.is_weight_num").alias("w_num"), F.col("d.is_weight_den").alias("w_den"), F.expr("try_cast(d.entry_version as bigint)").alias("declared_t"),
    )


def placed_rows(log: DataFrame) -> DataFrame:
    """One row for each replaced row of each batch witness: ord, step, sample_op, batch_rows, row, k, content_digest."""
    rows = log.where("op = 'batch'").select("ord", "step", F.col("sample_op_counter").alias("sample_op"), "batch_rows", F.explode("replaced").alias("p"))
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    return rows.select("ord", whole("step").alias("step"), "sample_op", whole("batch_rows").alias("batch_rows"), whole("p.row").alias("row"), whole("p.draw").cast("int").alias("k"), F.col("p.content_digest").alias("content_digest"))
