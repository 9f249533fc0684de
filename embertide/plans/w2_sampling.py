"""Decay, prefix scan, draws, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertide.functions import exact as X
from embertide.functions import priorities as P
from embertide.functions.decay import Decay, decay_table, expired, rebased
from embertide.operators import sampling as S
from embertide.plans.w1_groups import ROLL, rollouts
from embertide.session import table

QUERIES, ORACLE = {}, {}
DECAY, NOW = Decay(half_life=4, max_age=16, capacity=65536), 29
BASE = DECAY.base_epoch(NOW)
BETA = 0.4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_T = ", ".join(map(str, decay_table(DECAY.half_life)))
STATE = ROLL + f""", live AS (
  SELECT event_id AS slot, version, source, reward, prompt_id,
         (CASE WHEN reward = 0 THEN 0 ELSE greatest(1, floor(reward * 65536)) END)::BIGINT AS q
  FROM roll WHERE {NOW} - version <= {DECAY.max_age}),
state AS (
  SELECT *, ((q::HUGEINT * ([{_T}])[version % 4 + 1]) // 2147483648 * pow(2, version // 4 - {BASE})::HUGEINT)::BIGINT AS leaf FROM live),
scan AS (SELECT *, sum(leaf) OVER (ORDER BY slot)::BIGINT AS cum_after FROM state),
tot AS (SELECT count(*) AS n, sum(leaf)::BIGINT AS total, min(leaf) FILTER (WHERE leaf > 0) AS least FROM state)
"""


def state(spark, sf):
    return S.live_state(rollouts(spark, sf), DECAY, NOW, F.col("reward"))


@query(ROLL + f"SELECT event_id, {NOW} - version > {DECAY.max_age} AS expired FROM roll")
def filter_expired(spark, sf):
    return rollouts(spark, sf).select("event_id", expired(F.col("version"), NOW, DECAY.max_age).alias("expired"))


@query(STATE + "SELECT slot, q, version, leaf FROM state")
def scalar_leaf(spark, sf):
    return state(spark, sf).select("slot", "q", "version", F.col("leaf").cast("long").alias("leaf"))


@query(STATE + "SELECT slot, cum_after FROM scan")
def scan_prefix_sum(spark, sf):
    return S.prefix(state(spark, sf)).select("slot", F.col("cum_after").cast("long").alias("cum_after"))


@query(STATE + "SELECT n, total, least FROM tot")
def agg_total_min(spark, sf):
    return S.totals(state(spark, sf)).select("n", F.col("total").cast("long").alias("total"), F.col("least").cast("long").alias("least"))


@query(f"""SELECT l_linenumber AS version, l_linenumber // 4 AS epoch, greatest(0, l_linenumber - 16) // 4 AS base_epoch,
 l_linenumber // 4 - 0 > 4 AS rebase_due, count(*) AS n FROM lineitem GROUP BY ALL""")
def scalar_epochs(spark, sf):
    v = F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(v.alias("version")).agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "version", "cast(version div 4 as int) as epoch", f"cast(greatest(0, version - {DECAY.max_age}) div 4 as int) as base_epoch",
        f"version div 4 > {DECAY.max_shift} as rebase_due", "n")


@query(STATE + "SELECT slot, CASE WHEN leaf % 2 = 0 THEN leaf // 2 END AS shifted FROM state")
def rebase_shift(spark, sf):
    return state(spark, sf).select("slot", rebased(F.col("leaf"), 1).cast("long").alias("shifted"))


@query(STATE + f"SELECT slot, CASE WHEN slot % 2 = 0 THEN {NOW} ELSE version END AS version FROM state")
def scalar_version_after_update(spark, sf):
    return state(spark, sf).select("slot", F.when(F.col("slot") % 2 == 0, F.lit(NOW).cast("long")).otherwise(F.col("version")).alias("version"))


N_DRAWS = 512
_DRAWS = f"""draws AS (SELECT k, ((k * 2654435761 + 12345)::HUGEINT * 40503 % total)::BIGINT AS draw FROM range({N_DRAWS}) t(k), tot)"""


def sql_draws(spark, st):
    """Draws that SQL can make too; sample_keyed has the keyed ones."""
    total = S.totals(st).select("total")
    k = F.col("id").cast("decimal(38,0)")
    return spark.range(N_DRAWS).crossJoin(F.broadcast(total)).select(
        F.col("id").alias("k"), (((k * 2654435761 + 12345).cast("decimal(25,0)") * F.lit(40503).cast("decimal(6,0)")).cast("decimal(38,0)") % F.col("total")).cast("decimal(38,0)").alias("draw")
    )


def located(spark, sf):
    st = state(spark, sf)
    return S.locate(st, sql_draws(spark, st))


_LOCATED = STATE + f", {_DRAWS}, hit AS (SELECT k, draw, slot, version, leaf, source FROM draws JOIN scan ON draw >= cum_after - leaf AND draw < cum_after)"


@query(_LOCATED + " SELECT k, draw, slot, version FROM hit")
def sample_exact_locate(spark, sf):
    return located(spark, sf).select("k", F.col("draw").cast("long").alias("draw"), "slot", "version")


@query(_LOCATED + f""" SELECT k, slot, round(pow(n * leaf::DOUBLE / total::DOUBLE, -{BETA}) / pow(n * least::DOUBLE / total::DOUBLE, -{BETA}), 9) AS w FROM hit, tot""")
def sample_is_weight(spark, sf):
    w = P.importance_weight(F.col("n"), F.col("leaf"), F.col("total"), F.col("least"), BETA)
    return located(spark, sf).crossJoin(F.broadcast(S.totals(state(spark, sf)))).select("k", "slot", F.round(w, 9).alias("w"))


@query(_LOCATED + " SELECT k, slot, round(leaf::DOUBLE / total::DOUBLE, 15) AS probability FROM hit, tot")
def sample_probability(spark, sf):
    p = F.col("leaf").cast("double") / F.col("total").cast("double")
    return located(spark, sf).crossJoin(F.broadcast(S.totals(state(spark, sf)).select("total"))).select("k", "slot", F.round(p, 15).alias("probability"))


@query(_LOCATED + f""", w AS (SELECT pow(n * leaf::DOUBLE / total::DOUBLE, -{BETA}) / pow(n * least::DOUBLE / total::DOUBLE, -{BETA}) AS w FROM hit, tot)
SELECT round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM w""")
def agg_ess(spark, sf):
    w = P.importance_weight(F.col("n"), F.col("leaf"), F.col("total"), F.col("least"), BETA)
    ws = located(spark, sf).crossJoin(F.broadcast(S.totals(state(spark, sf)))).select(w.alias("w"))
    return ws.agg(F.round(F.pow(F.sum("w"), 2.0) / F.sum(F.col("w") * F.col("w")), 6).alias("ess"))


@query(_LOCATED + f" SELECT max({NOW} - version)::BIGINT AS staleness_max, sum({NOW} - version)::BIGINT AS staleness_sum FROM hit")
def agg_staleness(spark, sf):
    age = F.lit(NOW) - F.col("version")
    return located(spark, sf).agg(F.max(age).alias("staleness_max"), F.sum(age).alias("staleness_sum"))


@query(STATE + f"""SELECT slot FROM state WHERE NOT (SELECT bool_or(version > {NOW} - 3) FROM state)""")
def gate_min_entry_age(spark, sf):
    """Nothing may be drawn while any live entry is younger than three versions."""
    st = state(spark, sf)
    young = st.agg(F.coalesce(F.bool_or(F.col("version") > NOW - 3), F.lit(False)).alias("young"))
    return st.crossJoin(F.broadcast(young)).where("not young").select("slot")


@query(STATE + """, d AS (SELECT k, floor((k + 0.5) * total / 64)::BIGINT AS draw FROM range(64) t(k), tot)
SELECT k, draw, slot FROM d JOIN scan ON draw >= cum_after - leaf AND draw < cum_after""")
def sample_stratified(spark, sf):
    """One draw in the middle of each of 64 equal shares of the total."""
    st = state(spark, sf)
    d = spark.range(64).crossJoin(F.broadcast(S.totals(st).select("total"))).select(
        F.col("id").alias("k"), F.floor((F.col("id") + 0.5) * F.col("total").cast("double") / 64).cast("decimal(38,0)").alias("draw"))
    return S.locate(st, d).select("k", F.col("draw").cast("long").alias("draw"), "slot")


@query(STATE + """SELECT slot, round(least(1, greatest(0, pow(n * greatest(leaf::DOUBLE / total::DOUBLE, 1e-10), -0.5))), 9) AS w FROM state, tot""")
def sample_clipped_weight(spark, sf):
    p = F.col("leaf").cast("double") / F.col("total").cast("double")
    st = state(spark, sf)
    return st.crossJoin(F.broadcast(S.totals(st).drop("least"))).select("slot", F.round(P.clipped_weight(F.col("n"), p, 0.5), 9).alias("w"))


@query("""WITH s AS (SELECT event_id, value + 0.01 AS p FROM events),
c AS (SELECT event_id, (sum(p::DECIMAL(18,4)) OVER (ORDER BY event_id)) AS hi, p::DECIMAL(18,4) AS p FROM s),
d AS (SELECT k, (SELECT max(hi) FROM c) * (2 * k + 1) / 128 AS u FROM range(64) t(k))
SELECT k, event_id FROM d JOIN c ON u::DECIMAL(38,10) >= hi - p AND u::DECIMAL(38,10) < hi""")
def sample_float_descent(spark, sf):
    """Float replay: inverse CDF on four-decimal priorities, one draw in each of 64 strata."""
    s = table(spark, sf, "events").selectExpr("event_id", "cast((cast(value as double) + 0.01D) as decimal(18,4)) * 10000 as leaf")
    s = s.withColumn("leaf", F.col("leaf").cast("decimal(20,0)"))
    top = s.agg(F.sum("leaf").cast("decimal(38,0)").alias("t"))
    d = spark.range(64).crossJoin(F.broadcast(top)).selectExpr("id as k", "cast(floor(t * (2 * id + 1) / 128) as decimal(38,0)) as draw")
    return S.locate(s, d, "event_id").select("k", "event_id")


@query()
def sample_keyed(spark, sf):
    """512 keyed draws located in the state, with exact probability and weight."""
    st = state(spark, sf)
    t = S.totals(st)
    d = spark.range(N_DRAWS).crossJoin(F.broadcast(t.select("total"))).select(
        F.col("id").alias("k"), X.draw_udf(seed=42, buffer_id=7)(F.col("total"), F.col("id")).cast("decimal(38,0)").alias("draw"))
    hit = S.locate(st, d).crossJoin(F.broadcast(t))
    w = X.weight_udf(BETA)("n", "leaf", "least", "total")
    p = X.probability_udf("leaf", "total")
    return hit.select("k", F.col("draw").cast("string").alias("draw"), "slot", "prompt_id", "version", F.col("leaf").cast("string").alias("leaf"), p.alias("p"), w.alias("w")).selectExpr(
        "k", "draw", "slot", "prompt_id", "version", "leaf", "p.num as prob_num", "p.den as prob_den", "w.num as weight_num", "w.den as weight_den", "w.f as weight")


@query()
def keyed_draw(spark, sf):
    """The n = 1000, seed 0 draw of each event's id."""
    return table(spark, sf, "events").select("event_id", X.draw_udf(0, 0)(F.lit(1000), F.col("event_id")).cast("long").alias("draw"))


@query()
def content_digest(spark, sf):
    r = rollouts(spark, sf)
    tokens = F.array(F.col("event_id"), F.col("version"))
    return r.select("event_id", X.content_digest_udf(F.col("prompt_id").cast("string"), tokens, "reward").alias("digest"))


@query()
def float_hex(spark, sf):
    r = rollouts(spark, sf).select("event_id", "reward", X.float_hex("reward").alias("hex"))
    return r.select("event_id", "hex", (X.from_hex("hex") == F.col("reward")).alias("same"))


@query()
def scalar_exact_exp(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.exact_exp_udf(F.col("l_tax") - F.col("l_discount")).alias("e"))


@query()
def scalar_priority_int(spark, sf):
    return table(spark, sf, "events").select("event_id", X.priority_int_udf(F.col("value") + 1e-6).alias("p"))


@query()
def prompt_ids(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", X.prompt_id_udf(F.transform("embedding", lambda x: F.floor(F.abs(x) * 1000).cast("long"))).alias("prompt_id"))
