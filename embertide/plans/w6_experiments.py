"""Experiment reports: runs are orders by customer segment and seed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embertide.functions import answers as A
from embertide.operators import experiments as E
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RUNS = """WITH run AS (SELECT c_mktsegment AS arm, o_custkey % 3 AS seed, row_number() OVER (PARTITION BY c_mktsegment, o_custkey % 3 ORDER BY o_orderdate, o_orderkey) AS step,
  round(o_totalprice / 1000, 3) AS reward, o_orderkey % 7 + 1 AS rollouts FROM orders JOIN customer ON c_custkey = o_custkey)
"""
KEYS = ["arm", "seed"]


def runs(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.select(F.col("c_mktsegment").alias("arm"), (F.col("o_custkey") % 3).alias("seed"), "o_orderdate", "o_orderkey",
                 F.round(F.col("o_totalprice") / 1000, 3).alias("reward"), (F.col("o_orderkey") % 7 + 1).alias("rollouts"))
    return o.withColumn("step", F.row_number().over(Window.partitionBy("arm", "seed").orderBy("o_orderdate", "o_orderkey")).cast("long")).drop("o_orderdate", "o_orderkey")


@query(RUNS + "SELECT arm, seed, step, reward, rollouts FROM run")
def report_runs(spark, sf):
    return runs(spark, sf).select("arm", "seed", "step", "reward", "rollouts")


@query(RUNS + "SELECT arm, seed, step, round(avg(reward) OVER (PARTITION BY arm, seed ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS roll FROM run")
def win_rolling(spark, sf):
    return runs(spark, sf).select(*KEYS, "step", F.round(E.rolling(F.col("reward"), KEYS, "step", 10), 6).alias("roll"))


@query(RUNS + """, r AS (SELECT *, round(avg(reward) OVER (PARTITION BY arm, seed ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS roll FROM run)
SELECT arm, seed, min(step) FILTER (WHERE roll >= 200) AS first_step FROM r GROUP BY ALL""")
def win_steps_to_target(spark, sf):
    r = runs(spark, sf).withColumn("roll", F.round(E.rolling(F.col("reward"), KEYS, "step", 10), 6))
    return r.groupBy(*KEYS).agg(F.min(F.when(F.col("roll") >= 200, F.col("step"))).alias("first_step"))


@query(RUNS + """, c AS (SELECT *, sum(rollouts) OVER (PARTITION BY arm, seed ORDER BY step) AS spent FROM run),
k AS (SELECT * FROM c WHERE spent <= 300)
SELECT arm, seed, max(step) AS last_step, max(spent)::BIGINT AS spent FROM k GROUP BY ALL""")
def win_budget_cut(spark, sf):
    k = E.within_budget(runs(spark, sf), KEYS, "step", "rollouts", 300)
    return k.groupBy(*KEYS).agg(F.max("step").alias("last_step"), F.max("spent").alias("spent"))


@query(RUNS + """, q AS (SELECT *, row_number() OVER (PARTITION BY arm, seed ORDER BY step DESC) AS back, count(*) OVER (PARTITION BY arm, seed) AS n FROM run)
SELECT arm, seed, round(sum(reward::DECIMAL(18,3))::DOUBLE / count(*), 6) AS tail FROM q WHERE back <= greatest(1, n // 4) GROUP BY ALL""")
def win_last_quarter(spark, sf):
    q = E.last_quarter(runs(spark, sf), KEYS, "step")
    return q.groupBy(*KEYS).agg(F.round(F.sum(F.col("reward").cast("decimal(18,3)")).cast("double") / F.count(F.lit(1)), 6).alias("tail"))


@query(RUNS + """, z AS (SELECT arm, seed, step, reward, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS s FROM run
  WINDOW w AS (PARTITION BY arm, seed ORDER BY step ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT arm, seed, step, round(CASE WHEN n >= 5 AND s > 0 THEN (reward - m) / s END, 4) + 0.0 AS z FROM z""")
def win_running_z(spark, sf):
    return runs(spark, sf).select(*KEYS, "step", (F.round(E.running_z(F.col("reward"), KEYS, "step"), 4) + 0.0).alias("z"))


@query(RUNS + """, r AS (SELECT *, avg(reward) OVER (PARTITION BY arm, seed ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS roll FROM run)
SELECT arm, step, round(avg(roll), 6) AS curve, count(*) AS seeds FROM r GROUP BY ALL""")
def win_seed_mean_curve(spark, sf):
    r = runs(spark, sf).withColumn("roll", E.rolling(F.col("reward"), KEYS, "step", 10))
    return r.groupBy("arm", "step").agg(F.round(F.avg("roll"), 6).alias("curve"), F.count(F.lit(1)).alias("seeds"))


@query(RUNS + """, s AS (SELECT arm, seed, round(sum(reward::DECIMAL(18,3))::DOUBLE / count(*), 6) AS m FROM run GROUP BY ALL)
SELECT arm, count(*) AS n, round(avg(m), 5) AS mean, round(coalesce(stddev_samp(m), 0), 4) AS std FROM s GROUP BY 1""")
def report_mean_std(spark, sf):
    s = runs(spark, sf).groupBy(*KEYS).agg(F.round(F.sum(F.col("reward").cast("decimal(18,3)")).cast("double") / F.count(F.lit(1)), 6).alias("m"))
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 4).alias("std"))


@query(RUNS + """SELECT arm, seed, count(*) AS steps, sum(rollouts)::BIGINT AS rollouts, round(sum(reward::DECIMAL(18,3))::DOUBLE / count(*), 6) AS auc,
 max_by(reward, step) AS last_reward, count(*) FILTER (WHERE reward < 50) AS dead, round(sum(rollouts)::DOUBLE * 0.0004, 6) AS dollars, count(*) < 100 AS suspect FROM run GROUP BY ALL""")
def report_run_summary(spark, sf):
    return runs(spark, sf).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("rollouts").alias("rollouts"), F.round(F.sum(F.col("reward").cast("decimal(18,3)")).cast("double") / F.count(F.lit(1)), 6).alias("auc"),
        F.max_by("reward", "step").alias("last_reward"), F.count_if(F.col("reward") < 50).alias("dead"), F.round(F.sum("rollouts").cast("double") * 0.0004, 6).alias("dollars"), (F.count(F.lit(1)) < 100).alias("suspect"))


@query(RUNS + """, s AS (SELECT arm, seed, sum(rollouts)::BIGINT AS spent FROM run GROUP BY ALL), l AS (SELECT arm, list(spent ORDER BY spent) AS x FROM s GROUP BY 1)
SELECT arm, x[len(x) // 2 + 1] AS budget FROM l""")
def agg_median_budget(spark, sf):
    """The upper median over seeds."""
    s = runs(spark, sf).groupBy(*KEYS).agg(F.sum("rollouts").alias("spent"))
    x = F.sort_array(F.collect_list("spent"))
    return s.groupBy("arm").agg(x.alias("x")).select("arm", F.expr("element_at(x, cast(size(x) div 2 + 1 as int))").alias("budget"))


@query("SELECT l_returnflag, round(avg(l_linenumber), 6) AS mean, quantile_disc(l_linenumber, 0.9)::BIGINT AS p90, max(l_linenumber)::BIGINT AS max FROM lineitem GROUP BY 1")
def agg_age_p90(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_linenumber"), 6).alias("mean"), F.expr("percentile_disc(0.9) within group (order by l_linenumber)").cast("long").alias("p90"), F.max("l_linenumber").cast("long").alias("max"))


@query("""SELECT l.doc_id % 3 AS seed, a.doc_id AS item, a.quality - l.quality AS diff FROM labels a JOIN labels l ON l.doc_id = a.doc_id + 1""")
def join_paired_difference(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("item"), "quality")
    b = table(spark, sf, "labels").select((F.col("doc_id") - 1).alias("item"), F.col("quality").alias("other"))
    return a.join(b, "item").select(((F.col("item") + 1) % 3).alias("seed"), "item", (F.col("quality") - F.col("other")).alias("diff"))


@query("""WITH s AS (SELECT quality, doc_id, row_number() OVER (ORDER BY quality, doc_id) - 1 AS r, count(*) OVER () AS n FROM labels)
SELECT min(doc_id) FILTER (WHERE r = floor(0.025 * (n - 1))) AS lo, min(doc_id) FILTER (WHERE r = ceil(0.975 * (n - 1))) AS hi FROM s""")
def agg_percentile_bounds(spark, sf):
    """The rows at the bound ranks of the scores: ranked by doc_id inside each score, after the rows of lower scores."""
    from pyspark.sql import Window

    from embertide.operators.scan import ranked

    t = table(spark, sf, "labels").select("quality", "doc_id")
    sizes = t.groupBy("quality").agg(F.count(F.lit(1)).alias("size"))  # one row for each score
    w = Window.orderBy("quality").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"lower": F.coalesce(F.sum("size").over(w), F.lit(0)), "n": F.sum("size").over(Window.partitionBy())})
    t = ranked(t, "doc_id", "r", keys=["quality"]).join(F.broadcast(sizes), "quality").withColumn("r", F.col("r") + F.col("lower"))
    return t.agg(F.min(F.when(F.col("r") == F.floor(0.025 * (F.col("n") - 1)), F.col("doc_id"))).alias("lo"), F.min(F.when(F.col("r") == F.ceil(0.975 * (F.col("n") - 1)), F.col("doc_id"))).alias("hi"))


@query()
def bootstrap_ci(spark, sf):
    """Interval of the mean quality of four arms, over seeds x items."""
    return E.bootstrap(scores(spark, sf), ["arm"], "seed", "item", "score")


def scores(spark, sf):
    """Labels as evaluation scores: three seeds of an item are three documents in a row, all labelled."""
    item = F.floor(F.col("doc_id") / 3)
    d = table(spark, sf, "labels").groupBy(item.alias("item"), (F.col("doc_id") % 3).alias("seed")).agg(F.max("quality").cast("double").alias("score"))
    whole = d.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("item")
    return d.join(whole, "item", "left_semi").withColumn("arm", F.col("item") % 4)


@query()
def paired_bootstrap(spark, sf):
    """Interval of the difference of each return flag to N in mean discount, on the seeds that both have, item by item."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_linenumber") % 3).alias("seed"), (F.col("l_partkey") % 20).alias("item"))
    s = li.agg((F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("score"))
    return E.paired_bootstrap(s.where("arm <> 'N'"), s.where("arm = 'N'").drop("arm"), ["arm"], "seed", "item", "score")


@query(r"""WITH t AS (SELECT doc_id, text, CASE WHEN contains(text, '####') THEN string_split(text, '####')[-1] END AS tail FROM documents),
n AS (SELECT doc_id, regexp_extract_all(tail, '(^|[^0-9])(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 2) AS a, regexp_extract_all(text, '(^|[^0-9])(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 2) AS f FROM t)
SELECT doc_id, TRY_CAST(replace(coalesce(a[1], f[-1]), ',', '') AS DECIMAL(38,6))::DOUBLE AS answer FROM n""")
def str_answer_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.number_answer(F.col("text")).cast("double").alias("answer"))


@query()
def str_boxed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.boxed_udf("text").alias("boxed"))


@query("SELECT conv_id, max_by(text, turn) AS completion, length(max_by(text, turn)) % 2 = 0 AS even FROM conversations GROUP BY 1")
def str_completion_text(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("completion"))
    return c.withColumn("even", F.length("completion") % 2 == 0)


@query("SELECT conv_id, count(*) FILTER (WHERE length(text) <= 200) AS kept, count(*) FILTER (WHERE length(text) > 200) AS dropped FROM conversations GROUP BY 1")
def filter_fit_prompts(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(n <= 200).alias("kept"), F.count_if(n > 200).alias("dropped"))


@query("SELECT * FROM (SELECT DISTINCT c_mktsegment AS arm FROM customer) EXCEPT SELECT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey")
def set_missing_arms(spark, sf):
    c = table(spark, sf, "customer")
    done = c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.select(F.col("c_mktsegment").alias("arm")).distinct().join(done.select(F.col("c_mktsegment").alias("arm")), "arm", "left_anti")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def map_config_lookup(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
