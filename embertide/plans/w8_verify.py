"""Verification, reports and the remaining surface of the replay library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embertide.operators import eventlog as L
from embertide.plans.w4_log import LOG, log
from embertide.plans.w5_batches import DRAWS, draws
from embertide.plans.w6_experiments import RUNS, runs
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(LOG + """SELECT w.win, count(*) FILTER (WHERE op = 'insert') AS inserts, count(*) FILTER (WHERE op = 'sample') AS samples, count(*) FILTER (WHERE op = 'evict') AS evicts,
 count(o.insert_ord) AS resolved FROM win w LEFT JOIN occ o ON o.ord = w.ord GROUP BY 1""")
def transcript_windows(spark, sf):
    """Per version window: inserts, samples, evictions and samples that resolve to an example."""
    lg = L.version_windows(log(spark, sf))
    hits = L.occupants(log(spark, sf)).select("ord", "insert_ord")
    return lg.join(hits, "ord", "left").groupBy(F.col("window").alias("win")).agg(
        *(F.count_if(F.col("op") == o).alias(f"{o}s") for o in ("insert", "sample", "evict")), F.count("insert_ord").alias("resolved"))


@query(LOG + """SELECT o.step, o.ord, o.slot, o.insert_ord, i.value AS reward FROM occ o JOIN log i ON i.ord = o.insert_ord""")
def offline_replay(spark, sf):
    """Each sample opened: the example it drew, as training rows again."""
    lg = log(spark, sf)
    own = lg.where("op = 'insert'").select(F.col("ord").alias("insert_ord"), F.col("value").alias("reward"))
    return L.occupants(lg).join(own, "insert_ord").select("step", "ord", "slot", "insert_ord", "reward")


@query(LOG + """, n AS (SELECT ord, op, slot, value, row_number() OVER (PARTITION BY slot ORDER BY ord) AS nth FROM log)
SELECT a.slot, CASE WHEN a.op <> b.op AND (a.op = 'advance_version' OR b.op = 'advance_version') THEN 'schedule' WHEN a.op <> b.op THEN 'data'
  WHEN a.op = 'sample' THEN 'sampler' ELSE 'data' END AS class, count(*) AS n
FROM n a JOIN n b ON b.slot = a.slot + 1 AND b.nth = a.nth AND (a.op <> b.op OR a.value <> b.value) GROUP BY ALL""")
def diff_classes(spark, sf):
    """How the log of each slot differs from its neighbour's, by kind of cause."""
    n = log(spark, sf).withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy("ord")))
    b = n.select((F.col("slot") - 1).alias("slot"), "nth", F.col("op").alias("op2"), F.col("value").alias("v2"))
    d = n.join(b, ["slot", "nth"]).where("op <> op2 or value <> v2")
    kind = F.when((F.col("op") != F.col("op2")) & ((F.col("op") == "advance_version") | (F.col("op2") == "advance_version")), "schedule")
    kind = kind.when(F.col("op") != F.col("op2"), "data").when(F.col("op") == "sample", "sampler").otherwise("data")
    return d.groupBy("slot", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(LOG + """, m AS (SELECT slot, ord, op, lag(op) OVER (PARTITION BY slot ORDER BY ord) AS before FROM log WHERE op IN ('insert', 'evict', 'update'))
SELECT ord, CASE WHEN op = 'evict' AND coalesce(before, 'evict') = 'evict' THEN 'evict of an empty slot' WHEN op = 'update' AND coalesce(before, 'evict') = 'evict' THEN 'update of an empty slot' END AS problem
FROM m WHERE op IN ('evict', 'update') AND coalesce(before, 'evict') = 'evict'""")
def verify_slot_protocol(spark, sf):
    """Mutations of slots that hold nothing."""
    w = Window.partitionBy("slot").orderBy("ord")
    m = log(spark, sf).where("op in ('insert', 'evict', 'update')").withColumn("before", F.coalesce(F.lag("op").over(w), F.lit("evict")))
    bad = m.where("op in ('evict', 'update') and before = 'evict'")
    return bad.select("ord", F.concat("op", F.lit(" of an empty slot")).alias("problem"))


@query(LOG + """, s AS (SELECT ord, slot, step, lag(step) OVER (PARTITION BY slot ORDER BY ord) AS prev FROM log WHERE op = 'sample')
SELECT slot, count(*) AS samples, count(*) FILTER (WHERE prev > step) AS backwards, count(*) FILTER (WHERE prev = step) AS repeats FROM s GROUP BY 1""")
def verify_monotone_samples(spark, sf):
    w = Window.partitionBy("slot").orderBy("ord")
    s = log(spark, sf).where("op = 'sample'").withColumn("prev", F.lag("step").over(w))
    return s.groupBy("slot").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("prev") > F.col("step")).alias("backwards"), F.count_if(F.col("prev") == F.col("step")).alias("repeats"))


@query(LOG + """, s AS (SELECT ord, slot, step, lead(step) OVER (PARTITION BY slot ORDER BY ord) AS nxt FROM log WHERE op = 'sample')
SELECT ord, nxt IS NULL OR nxt <= step AS abandoned_ok FROM s""")
def verify_abandoned_samples(spark, sf):
    """An unwitnessed sample is fine if the next is at the same or an earlier version."""
    w = Window.partitionBy("slot").orderBy("ord")
    s = log(spark, sf).where("op = 'sample'").withColumn("nxt", F.lead("step").over(w))
    return s.select("ord", (F.col("nxt").isNull() | (F.col("nxt") <= F.col("step"))).alias("abandoned_ok"))


@query(LOG + """, r AS (SELECT ord, slot, op, sum((op IN ('insert', 'evict') AND lop IS DISTINCT FROM op)::INT) OVER (PARTITION BY slot ORDER BY ord) AS run
  FROM (SELECT *, lag(op) OVER (PARTITION BY slot ORDER BY ord) AS lop FROM chg))
SELECT slot, run::BIGINT AS run, op, count(*) AS n, min(ord) AS first_ord FROM r GROUP BY ALL""")
def win_eviction_runs(spark, sf):
    """Runs of inserts and evictions of a slot (gaps and islands)."""
    w = Window.partitionBy("slot").orderBy("ord")
    c = log(spark, sf).where("op in ('insert', 'evict')").withColumn("turn", (~F.lag("op").over(w).eqNullSafe(F.col("op"))).cast("int"))
    c = c.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("slot", "run", "op").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@query(DRAWS + "SELECT step, draw FROM d WHERE NOT abs(ratio) <= 0.05")
def choose_declines(spark, sf):
    """The older rule: any ratio over the limit or not finite."""
    return draws(spark, sf).where(~(F.abs("ratio") <= 0.05)).select("step", "draw")


@query(DRAWS + """SELECT step, count(*) AS n, count(*) FILTER (WHERE age <= 4) AS replayed, round(count(*) FILTER (WHERE age <= 4) / count(*), 9) AS replay_fraction,
 count(DISTINCT slot) AS slots, count(DISTINCT grp) AS groups FROM d GROUP BY 1""")
def step_diagnostics(spark, sf):
    new = F.count_if(F.col("age") <= 4)
    return draws(spark, sf).groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), new.alias("replayed"), F.round(new / F.count(F.lit(1)), 9).alias("replay_fraction"), F.countDistinct("slot").alias("slots"), F.countDistinct("grp").alias("groups"))


@query(DRAWS + "SELECT count(*) AS generated, count(*) FILTER (WHERE age <= 4) AS rows, round(100.0::DOUBLE * count(*) FILTER (WHERE age <= 4) / count(*), 6) AS share FROM d")
def replay_summary(spark, sf):
    new = F.count_if(F.col("age") <= 4)
    return draws(spark, sf).agg(F.count(F.lit(1)).alias("generated"), new.alias("rows"), F.round(new * 100.0 / F.count(F.lit(1)), 6).alias("share"))


@query(DRAWS + "SELECT step, count(*) AS n, count(DISTINCT draw) AS draws, count(*) = count(DISTINCT draw) AS unique_draws FROM d GROUP BY 1")
def check_unique_draws(spark, sf):
    g = draws(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("draw").alias("draws"))
    return g.withColumn("unique_draws", F.col("n") == F.col("draws"))


@query(RUNS + "SELECT arm, seed, max_by(reward, step) FILTER (WHERE rollouts > 3) AS final FROM run GROUP BY ALL")
def report_final_score(spark, sf):
    """The last evaluation that kept its items."""
    kept = F.when(F.col("rollouts") > 3, F.col("step"))
    return runs(spark, sf).groupBy("arm", "seed").agg(F.max_by(F.col("reward"), kept).alias("final"))


@query("SELECT doc_id % 100 AS item, round(avg(quality), 9) AS accuracy, count(*) AS n FROM labels GROUP BY 1")
def report_item_accuracy(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("doc_id") % 100).alias("item")).agg(F.round(F.avg("quality"), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("""WITH arms AS (SELECT DISTINCT c_mktsegment AS arm FROM customer), seeds AS (SELECT unnest([0, 1, 2])::BIGINT AS seed)
SELECT arm, seed FROM arms, seeds WHERE NOT (arm = 'MACHINERY' AND seed > 0)""")
def plan_arms(spark, sf):
    """The grid of arms and seeds; a stress arm runs on the first seed only."""
    arms = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("arm")).distinct()
    grid = arms.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in range(3)))))
    return grid.where("not (arm = 'MACHINERY' and seed > 0)")


@query("""SELECT round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view, user_id % 10 AS game FROM events GROUP BY 3""")
def report_pivot(spark, sf):
    """Result table: one row for each game, one column for each buffer."""
    p = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("game")).pivot("event_type", ["click", "view"]).avg("value")
    return p.select("game", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("SELECT event_id, coalesce(NULLIF(event_type, 'view'), NULLIF(props, ''), 'unknown') AS provenance FROM events")
def provenance_lookup(spark, sf):
    blank = lambda c, v: F.when(F.col(c) != v, F.col(c))
    return table(spark, sf, "events").select("event_id", F.coalesce(blank("event_type", "view"), blank("props", ""), F.lit("unknown")).alias("provenance"))


@query(RUNS + "SELECT arm, seed, count(DISTINCT rollouts) = 7 AS same_configuration, count(*) = count(DISTINCT step) AS steps_once FROM run GROUP BY ALL")
def report_consistency(spark, sf):
    return runs(spark, sf).groupBy("arm", "seed").agg((F.countDistinct("rollouts") == 7).alias("same_configuration"), (F.count(F.lit(1)) == F.countDistinct("step")).alias("steps_once"))


@query("SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), max(value) FILTER (WHERE event_type = 'signup')) AS metric FROM events GROUP BY 1")
def rename_with_fallback(spark, sf):
    top = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(top("purchase"), top("signup")).alias("metric"))


@query("SELECT event_type, median(value) AS median, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def agg_median_spread(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT insert_ord, times FROM (" + LOG + """SELECT i.ord AS insert_ord, count(o.ord) AS times FROM (SELECT * FROM log WHERE op = 'insert') i LEFT JOIN occ o ON o.insert_ord = i.ord GROUP BY 1)
ORDER BY times DESC, insert_ord LIMIT 20""")
def topk_exposure(spark, sf):
    """The 20 most sampled examples."""
    return L.exposure(log(spark, sf)).orderBy(F.desc("times"), "insert_ord").limit(20).select("insert_ord", "times")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 50")
def topk_seeded_shuffle(spark, sf):
    """A seeded shuffle, the first 50: sampling without replacement by a keyed hash."""
    return table(spark, sf, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(50).select("doc_id")
