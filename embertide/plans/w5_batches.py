"""Batch mixing, row replacement and the staleness policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertide.operators import batches as B
from embertide.plans.w1_groups import LINES, lines
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Draws of a step: the lines of an order, numbered. Ties by all keys.
DRAWS = """WITH d AS (SELECT l_suppkey AS step, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS draw,
  l_tax - l_discount AS ratio, round(1 / (1 + l_quantity), 12) AS w, l_linenumber AS age, l_orderkey % 8 AS grp, l_partkey AS slot FROM lineitem)
"""


def draws(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("step"), F.row_number().over(w).cast("long").alias("draw"), (F.col("l_tax") - F.col("l_discount")).alias("ratio"),
        F.round(1 / (1 + F.col("l_quantity")), 12).alias("w"), F.col("l_linenumber").alias("age"), (F.col("l_orderkey") % 8).alias("grp"), F.col("l_partkey").alias("slot"))


@query(DRAWS + "SELECT step, draw, CASE WHEN age > 4 THEN 'age' END AS reason FROM d")
def policy_age(spark, sf):
    return B.decide(draws(spark, sf), B.Policy(max_age=4)).select("step", "draw", "reason")


@query(DRAWS + "SELECT step, draw, CASE WHEN abs(ratio) > 0.05 THEN 'drift' END AS reason FROM d")
def policy_gate(spark, sf):
    return B.decide(draws(spark, sf), B.Policy(max_log_ratio=0.05)).select("step", "draw", "reason")


VICTIMS = """, o AS (SELECT *, row_number() OVER v AS i, sum(w::DECIMAL(20,12)) OVER r AS s, sum((w::DECIMAL(20,12) * w::DECIMAL(20,12))::DECIMAL(30,18)) OVER r AS q, count(*) OVER r AS rest
  FROM {} WINDOW v AS (PARTITION BY step ORDER BY abs(ratio) DESC, draw), r AS (PARTITION BY step ORDER BY abs(ratio) DESC, draw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
stop AS (SELECT step, min(i) AS stop FROM o WHERE rest <= 1 OR s::DOUBLE * s::DOUBLE >= 0.5 * rest * q::DOUBLE GROUP BY 1)
"""


@query(DRAWS + VICTIMS.format("d") + "SELECT step, draw, CASE WHEN i < stop THEN 'ess' END AS reason FROM o JOIN stop USING (step)")
def policy_ess_floor(spark, sf):
    return B.decide(draws(spark, sf), B.Policy(ess_floor=0.5)).select("step", "draw", "reason")


@query(DRAWS + """, m AS (SELECT step, grp, sum((w * exp(ratio))::DECIMAL(38,12))::DOUBLE AS mass, 0.0625 * count(*) AS cap FROM d GROUP BY ALL)
SELECT step, draw, round(CASE WHEN mass > cap THEN cap / mass ELSE 1 END, 9) AS scale FROM d JOIN m USING (step, grp)""")
def policy_mass_cap(spark, sf):
    return B.decide(draws(spark, sf), B.Policy(mass_cap=-0.9375)).select("step", "draw", F.round("scale", 9).alias("scale"))


ALL = B.Policy(max_age=6, ess_floor=0.5, mass_cap=-0.875, max_log_ratio=0.06)
DECIDED = DRAWS + ", k AS (SELECT * FROM d WHERE age <= 6)" + VICTIMS.format("k") + """,
one AS (SELECT d.*, CASE WHEN d.age > 6 THEN 'age' WHEN i < stop THEN 'ess' END AS r1 FROM d LEFT JOIN o USING (step, draw) LEFT JOIN stop ON stop.step = d.step),
m AS (SELECT step, grp, sum((w * exp(ratio))::DECIMAL(38,12)) FILTER (WHERE r1 IS NULL)::DOUBLE AS mass, 0.125 * count(*) FILTER (WHERE r1 IS NULL) AS cap FROM one GROUP BY ALL),
dec AS (SELECT one.*, coalesce(r1, CASE WHEN abs(ratio) > 0.06 THEN 'drift' END) AS reason,
  CASE WHEN r1 IS NULL AND mass > cap AND NOT abs(ratio) > 0.06 THEN cap / mass ELSE 1 END AS scale FROM one JOIN m USING (step, grp))
"""


def decided(spark, sf):
    return B.decide(draws(spark, sf), ALL)


@query(DECIDED + "SELECT step, draw, reason, round(scale, 9) AS scale FROM dec")
def policy_all(spark, sf):
    return decided(spark, sf).select("step", "draw", "reason", F.round("scale", 9).alias("scale"))


@query(DECIDED + """SELECT slot, CASE WHEN bool_or(reason = 'drift') THEN 'drift' ELSE 'age' END AS reason FROM dec GROUP BY 1
HAVING bool_and(coalesce(reason IN ('drift', 'age'), false))""")
def evictions_for(spark, sf):
    return B.evictions(decided(spark, sf))


@query(DECIDED + """SELECT step, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'drift') AS declined_drift,
 count(*) FILTER (WHERE reason = 'age') AS declined_age, count(*) FILTER (WHERE reason = 'ess') AS declined_ess, count(*) FILTER (WHERE scale < 1) AS rescaled,
 round(min(scale), 9) AS min_scale, max(age)::BIGINT AS staleness_max, sum(age)::BIGINT AS staleness_sum, round(max(abs(ratio)), 9) AS max_log_ratio FROM dec GROUP BY 1""")
def step_telemetry(spark, sf):
    t = B.step_telemetry(decided(spark, sf))
    return t.withColumns({c: F.round(c, 9) for c in ("min_scale", "max_log_ratio")})


@query(DECIDED + "SELECT step, draw, round(w * scale * 2, 9) AS advantage FROM dec WHERE reason IS NULL")
def scalar_weighted_advantage(spark, sf):
    return decided(spark, sf).where("reason is null").select("step", "draw", F.round(F.col("w") * F.col("scale") * 2, 9).alias("advantage"))


@query("SELECT vec_id, round(list_avg([x::DOUBLE * 0.5 FOR x IN embedding]), 9) + 0.0 AS ratio FROM embeddings")
def agg_log_ratio_mean(spark, sf):
    """Mean of current minus behaviour log-probabilities of a sequence."""
    diff = F.zip_with(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double") * 0.5), lambda a, b: a - b)
    total = F.aggregate(diff, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", (F.round(total / F.greatest(F.size("embedding"), F.lit(1)), 9) + 0.0).alias("ratio"))


@query("SELECT vec_id, round(list_sum([x::DOUBLE * 0.5 FOR x IN embedding]), 8) + 0.0 AS ratio FROM embeddings")
def agg_log_ratio_sum(spark, sf):
    diff = F.zip_with(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double") * 0.5), lambda a, b: a - b)
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x), 8) + 0.0).alias("ratio"))


@query("SELECT l_suppkey, round(sum(abs(l_tax - l_discount)::DECIMAL(18,6))::DOUBLE / count(*), 9) AS mean_abs, round(max(abs(l_tax - l_discount)), 9) AS max_abs FROM lineitem GROUP BY 1")
def agg_abs_log_ratio(spark, sf):
    r = F.abs(F.col("l_tax") - F.col("l_discount"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(r.cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 9).alias("mean_abs"), F.round(F.max(r), 9).alias("max_abs"))


@query("""WITH t AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(x[1:6], [0 FOR i IN range(greatest(6 - len(x), 0))]), ',') AS completion,
 array_to_string(list_concat([0 FOR i IN range(greatest(6 - len(x), 0))], x[1:6]), ',') AS prompt FROM t""")
def array_pad(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    x = F.transform("s", lambda s: s.l_partkey)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return t.select("l_orderkey", joined(B.pad(x, 6, 0)).alias("completion"), joined(B.pad(x, 6, 0, left=True)).alias("prompt"))


@query("""WITH n AS (SELECT o_orderkey, max(o_custkey) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN c IS NOT NULL THEN 1.0 ELSE l_discount END::DOUBLE AS l_discount, c IS NOT NULL AS replaced
FROM lineitem LEFT JOIN n ON o_orderkey = l_orderkey""")
def array_write_rows(spark, sf):
    """Lines of finished orders take the reward of their replacement."""
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.lit(1.0).alias("l_discount"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    return B.write_rows(li, new, ["l_orderkey"], ["l_discount"])


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_discount) > 1 AS live FROM lineitem GROUP BY 1)
SELECT l_orderkey, live FROM g ORDER BY live DESC, l_orderkey LIMIT 500""")
def set_fill_plan(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"))
    return B.fill_plan(g, F.col("lo") < F.col("hi"), "l_orderkey", 500).select("l_orderkey", "live")


@query(LINES + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM r
WHERE l_orderkey IN (SELECT l_orderkey FROM r GROUP BY 1 HAVING bool_and(adv = 0))""")
def join_dead_rows(spark, sf):
    return B.dead_rows(lines(spark, sf), "l_orderkey", F.col("adv")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT label, vec_id, dense_rank() OVER (ORDER BY first) AS grp FROM (SELECT label, vec_id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings)")
def group_labels(spark, sf):
    """Groups numbered by their first row: ranks of group minima, not of rows."""
    from embertide.operators.scan import ranked

    v = table(spark, sf, "embeddings").select("label", "vec_id")
    first = ranked(v.groupBy("label").agg(F.min("vec_id").alias("first")), "first", "grp")
    return v.join(first.select("label", (F.col("grp") + 1).alias("grp")), "label")


@query("SELECT vec_id, vec_id // 8 AS grp, vec_id % 8 AS member FROM embeddings")
def contiguous_groups(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id", "vec_id div 8 as grp", "vec_id % 8 as member")


@query("""SELECT l_returnflag, (l_tax >= 0.04) AS clipped_up, count(*) AS tokens, round(sum(CASE WHEN abs(l_tax - l_discount) > 0.04 THEN 1 ELSE 0 END) / count(*), 9) AS clip_fraction
FROM lineitem GROUP BY ALL""")
def agg_clip_fraction(spark, sf):
    clip = F.avg((F.abs(F.col("l_tax") - F.col("l_discount")) > 0.04).cast("double"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_tax") >= 0.04).alias("clipped_up")).agg(F.count(F.lit(1)).alias("tokens"), F.round(clip, 9).alias("clip_fraction"))


@query("SELECT l_returnflag, round(sum((exp(l_tax - l_discount) - (l_tax - l_discount) - 1)::DECIMAL(30,15))::DOUBLE / count(*), 9) AS kl FROM lineitem GROUP BY 1")
def agg_kl_k3(spark, sf):
    d = F.col("l_tax") - F.col("l_discount")
    k3 = (F.exp(d) - d - 1).cast("decimal(30,15)")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(k3).cast("double") / F.count(F.lit(1)), 9).alias("kl"))


@query("""SELECT l_linestatus, count(*) AS tokens, round(max(abs(l_tax - l_discount)), 9) AS max_diff, count(*) FILTER (WHERE abs(l_tax - l_discount) > 0.08) AS confident,
 count(*) FILTER (WHERE abs(l_tax - l_discount) > 0.08) > 0.1 * count(*) AS stale FROM lineitem GROUP BY 1""")
def agg_engine_probe(spark, sf):
    d = F.abs(F.col("l_tax") - F.col("l_discount"))
    g = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.max(d), 9).alias("max_diff"), F.count_if(d > 0.08).alias("confident"))
    return g.withColumn("stale", F.col("confident") > 0.1 * F.col("tokens"))
