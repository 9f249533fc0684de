"""Rollout groups: validation, statistics, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embertide.functions import priorities as P
from embertide.functions.decay import quantize
from embertide.operators import groups as G
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The rollouts of events, as SQL.
ROLL = """WITH roll AS (
  SELECT event_id, user_id AS prompt_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS version,
         row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) - 1 AS member,
         event_type AS source, value / 100 AS reward, value > 100 AS success FROM events),
grp AS (
  SELECT prompt_id, version, count(*) AS n, sum(reward::DECIMAL(28,6))::DOUBLE AS s,
         sum((reward * reward)::DECIMAL(38,12))::DOUBLE AS ss, count(*) FILTER (WHERE success) AS n_success
  FROM roll GROUP BY ALL)
"""


def rollouts(spark, sf: str) -> DataFrame:
    return G.rollouts_of_events(table(spark, sf, "events"))


@query(ROLL + "SELECT event_id, prompt_id, version, member, source, reward, success FROM roll")
def source_rollouts(spark, sf):
    return rollouts(spark, sf)


@query(ROLL + "SELECT prompt_id, version, n, round(s / n, 9) AS mean_reward FROM grp")
def agg_group_mean(spark, sf):
    return G.group_stats(rollouts(spark, sf)).select("prompt_id", "version", "n", F.round("mean_reward", 9).alias("mean_reward"))


@query(ROLL + "SELECT prompt_id, version, round(sqrt(greatest(ss / n - (s / n) * (s / n), 0)), 6) AS reward_std FROM grp")
def agg_group_std(spark, sf):
    return G.group_stats(rollouts(spark, sf)).select("prompt_id", "version", F.round("reward_std", 6).alias("reward_std"))


@query(ROLL + "SELECT prompt_id, version, n_success, n_success / n AS pass_rate FROM grp")
def agg_pass_rate(spark, sf):
    return G.group_stats(rollouts(spark, sf)).select("prompt_id", "version", "n_success", "pass_rate")


@query(ROLL + "SELECT event_id, round(reward - s / n, 9) + 0.0 AS advantage FROM roll JOIN grp USING (prompt_id, version)")
def win_advantage(spark, sf):
    return G.with_stats(rollouts(spark, sf)).select("event_id", (F.round("advantage", 9) + 0.0).alias("advantage"))


@query(ROLL + "SELECT event_id, round(abs(reward - s / n) + 1e-6, 9) AS priority FROM roll JOIN grp USING (prompt_id, version)")
def prio_advantage(spark, sf):
    p = P.advantage_priority(F.col("reward"), F.col("mean_reward"))
    return G.with_stats(rollouts(spark, sf)).select("event_id", F.round(p, 9).alias("priority"))


@query(ROLL + """SELECT event_id, round(exp(-0.5 * pow((n_success / n - 0.5) / 0.25, 2)) + 1e-6, 9) AS priority
FROM roll JOIN grp USING (prompt_id, version)""")
def prio_target(spark, sf):
    return G.with_stats(rollouts(spark, sf)).select("event_id", F.round(P.target_priority(F.col("pass_rate")), 9).alias("priority"))


@query(ROLL + """SELECT event_id, round((n_success / n) * (1 - n_success / n) + 1e-6, 9) AS priority
FROM roll JOIN grp USING (prompt_id, version)""")
def prio_variance(spark, sf):
    return G.with_stats(rollouts(spark, sf)).select("event_id", F.round(P.variance_priority(F.col("pass_rate")), 9).alias("priority"))


@query(ROLL + "SELECT event_id, round(reward / (1 + abs(reward - 1) * 0.5), 9) AS priority FROM roll")
def prio_drift(spark, sf):
    p = P.drift_priority(F.col("reward"), F.col("reward") - 1, 0.5)
    return rollouts(spark, sf).select("event_id", F.round(p, 9).alias("priority"))


@query(ROLL + "SELECT event_id, round(abs(reward) + 1e-6, 9) AS priority, 1.0::DOUBLE AS uniform FROM roll")
def prio_stored(spark, sf):
    return rollouts(spark, sf).select("event_id", F.round(P.stored_priority(F.col("reward")), 9).alias("priority"), F.lit(1.0).alias("uniform"))


@query(ROLL + """SELECT event_id, (CASE WHEN reward = 0 THEN 0 ELSE greatest(1, floor(reward * 65536)) END)::BIGINT AS q FROM roll""")
def scalar_quantize(spark, sf):
    return rollouts(spark, sf).select("event_id", quantize(F.col("reward")).alias("q"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  (l_quantity >= 1 AND l_discount >= 0 AND l_discount <= 1 AND l_linenumber > 0) AS valid FROM lineitem""")
def filter_valid_rollouts(spark, sf):
    """A rollout of l_linenumber tokens, each with log-probability -discount."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    tokens = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    ok = G.valid_rollout(tokens, F.transform(tokens, lambda t: -F.col("l_discount")), F.col("l_discount")) & (F.col("l_quantity") >= 1)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (ok & (F.col("l_discount") <= 1)).alias("valid"))


@query("SELECT doc_id, (source IS NULL OR (length(source) <= 256 AND length(trim(source)) > 0)) AS valid FROM documents")
def filter_valid_source(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.valid_source(F.col("source")).alias("valid"))


@query(ROLL + "SELECT event_id, reward > 0 AS is_success FROM roll")
def filter_is_success(spark, sf):
    return rollouts(spark, sf).select("event_id", (F.col("reward") > 0).alias("is_success"))


LINES = """WITH g AS (SELECT l_orderkey, count(*) AS n, min(l_discount) AS lo, max(l_discount) AS hi,
  sum(l_discount::DECIMAL(18,4))::DOUBLE / count(*) AS m FROM lineitem GROUP BY 1),
r AS (SELECT lineitem.*, m, n, lo, hi, l_discount - m AS adv FROM lineitem JOIN g USING (l_orderkey))
"""


def lines(spark, sf):
    w = Window.partitionBy("l_orderkey")
    li = table(spark, sf, "lineitem")
    n = F.count(F.lit(1)).over(w)
    mean = F.sum(F.col("l_discount").cast("decimal(18,4)")).over(w).cast("double") / n
    return li.withColumns({"n": n, "m": mean}).withColumn("adv", F.col("l_discount") - F.col("m"))


@query(LINES + """SELECT l_orderkey, count(*) AS n FROM r GROUP BY 1
HAVING bool_and(adv = 0) OR (count(DISTINCT l_discount) = 1 AND count(*) >= 2)""")
def filter_dead_groups(spark, sf):
    g = lines(spark, sf).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("adv") == 0).alias("zero"), (F.min("l_discount") == F.max("l_discount")).alias("one")
    )
    return g.where("zero or (one and n >= 2)").select("l_orderkey", "n")


@query(LINES + """SELECT l_orderkey, bool_and(abs(adv) < 1e-3) AS near_dead, count(*) FILTER (WHERE abs(adv) < 1e-3) AS negligible FROM r GROUP BY 1""")
def filter_near_dead(spark, sf):
    small = F.abs("adv") < 1e-3
    return lines(spark, sf).groupBy("l_orderkey").agg(F.bool_and(small).alias("near_dead"), F.count_if(small).alias("negligible"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_discount) > 1 AND bool_and(isfinite(l_discount))")
def filter_live_groups(spark, sf):
    finite = F.bool_and(~F.isnan("l_discount") & (F.abs("l_discount") < float("inf")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), finite.alias("ok"))
    return g.where("ok and lo < hi").select("l_orderkey")


@query("""WITH g AS (SELECT l_suppkey, count(*) n, min(l_tax) lo, max(l_tax) hi FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (WHERE lo = hi AND lo < 0.04) AS all_wrong, count(*) FILTER (WHERE lo = hi AND lo >= 0.04) AS all_right,
 count(*) FILTER (WHERE lo < hi) AS mixed FROM g""")
def agg_group_outcomes(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    return g.agg(F.expr("count_if(lo = hi and lo < 0.04D)").alias("all_wrong"),
                 F.expr("count_if(lo = hi and lo >= 0.04D)").alias("all_right"), F.expr("count_if(lo < hi)").alias("mixed"))


@query("SELECT event_id, CASE WHEN value / 100 > 0 THEN 0.1 ELSE -1.0 END::DOUBLE AS advantage FROM events")
def scalar_wreinforce(spark, sf):
    return table(spark, sf, "events").select("event_id", P.reinforce_advantage(F.col("value") / 100).alias("advantage"))


@query("""SELECT l_orderkey, count(DISTINCT (l_discount, l_tax)) AS tuples FROM lineitem GROUP BY 1""")
def agg_reward_tuples(spark, sf):
    """Distinct reward tuples of a group."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.struct("l_discount", "l_tax")).alias("tuples"))


@query("SELECT l_orderkey, sum(l_linenumber)::BIGINT AS tokens, count(*) AS rows FROM lineitem GROUP BY 1")
def agg_token_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("tokens"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT event_id, round(CASE WHEN value > 50 THEN value / 100 * 0.5 + 1 ELSE value / 100 * 0.5 END, 9) AS reward FROM events""")
def agg_reward_sum(spark, sf):
    """Weighted sum of two reward functions, one of which abstains (null) on small values."""
    from embertide.operators.experiments import reward_sum

    v = F.col("value") / 100
    second = F.when(F.col("value") > 50, F.lit(1.0))
    return table(spark, sf, "events").select("event_id", F.round(reward_sum([v, second], [0.5, 1.0]), 9).alias("reward"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) n, max(value) v FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS rewards FROM g WHERE v >= 20 GROUP BY 1""")
def map_reward_functions(spark, sf):
    """Per-function rewards as a map, abstaining functions (value under 20) left out."""
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    g = g.withColumn("r", F.when(F.col("v") >= 20, F.col("n")))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "r"))).alias("m"))
    m = m.withColumn("e", F.array_sort(F.map_entries(F.map_filter("m", lambda k, v: v.isNotNull())))).where("size(e) > 0")
    return m.select("user_id", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x.key, x.value)), ",").alias("rewards"))


@query(ROLL + """, s AS (SELECT sum(n) AS total, max(n) AS widest, count(*) AS groups FROM grp)
SELECT total::BIGINT AS total, widest::BIGINT AS widest, groups FROM s""")
def agg_ingestion_summary(spark, sf):
    g = G.group_stats(rollouts(spark, sf))
    return g.agg(F.sum("n").alias("total"), F.max("n").alias("widest"), F.count(F.lit(1)).alias("groups"))
