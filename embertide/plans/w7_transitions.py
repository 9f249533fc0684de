"""Classic transitions over events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embertide.operators import transitions as T
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EP = """WITH ep AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode FROM events)
"""


@query(EP + "SELECT event_id, user_id, episode FROM ep")
def win_episodes(spark, sf):
    return T.episodes(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", "episode")


@query(EP + """, w AS (SELECT user_id, event_id, list(value) OVER w AS r, last_value(event_id) OVER w AS last, last_value(event_type = 'error') OVER w AS done
  FROM ep WINDOW w AS (PARTITION BY user_id, episode ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT user_id, event_id, round(r[1] + 0.99 * coalesce(r[2], 0) + 0.99 * 0.99 * coalesce(r[3], 0), 6) AS g, len(r) AS steps, last, done FROM w WHERE len(r) = 3 OR done""")
def nstep_returns(spark, sf):
    g = T.nstep_returns(table(spark, sf, "events"), "user_id", "event_id", F.col("value"), F.col("event_type") == "error", 3, 0.99)
    return g.withColumn("g", F.round("g", 6))


@query("""WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT a.vec_id, b.vec_id AS new_goal FROM t a JOIN t b ON a.label = b.label AND b.t = a.n - 1""")
def her_final(spark, sf):
    return T.hindsight(table(spark, sf, "embeddings"), "label", "vec_id", "vec_id", "final").select("vec_id", "new_goal")


@query("""WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
k AS (SELECT *, unnest(range(4)) AS j FROM t)
SELECT k.vec_id, k.j, b.vec_id AS new_goal FROM k JOIN t b ON k.label = b.label AND b.t = k.t + (k.vec_id * 31 + k.j * 17 + 7) % (k.n - k.t)""")
def her_future(spark, sf):
    return T.hindsight(table(spark, sf, "embeddings"), "label", "vec_id", "vec_id", "future", 4).select("vec_id", F.col("j").cast("long").alias("j"), "new_goal")


@query("""WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
k AS (SELECT *, unnest(range(4)) AS j FROM t)
SELECT k.vec_id, k.j, b.vec_id AS new_goal FROM k JOIN t b ON k.label = b.label AND b.t = (k.vec_id * 31 + k.j * 17 + 7) % k.n""")
def her_episode(spark, sf):
    return T.hindsight(table(spark, sf, "embeddings"), "label", "vec_id", "vec_id", "episode", 4).select("vec_id", F.col("j").cast("long").alias("j"), "new_goal")


@query("""WITH g AS (SELECT label, max_by(embedding, vec_id) AS goal FROM embeddings GROUP BY 1)
SELECT vec_id, len(list_concat(embedding, goal)) AS width, round(list_concat(embedding, goal)[-1], 6) AS tail FROM embeddings JOIN g USING (label)""")
def array_goal_concat(spark, sf):
    v = table(spark, sf, "embeddings")
    g = v.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("goal"))
    x = v.join(g, "label").withColumn("x", F.concat("embedding", "goal"))
    return x.select("vec_id", F.size("x").cast("long").alias("width"), F.round(F.element_at("x", -1), 6).alias("tail"))


@query("""WITH w AS (SELECT event_id, user_id, count(*) OVER w AS n, avg(value) OVER w AS m, var_samp(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, n, round(m, 8) AS mean, round(CASE WHEN n > 1 THEN v + 1.0 / (n - 1) ELSE 1 END, 7) AS var FROM w""")
def running_normalizer(spark, sf):
    m = T.running_moments(table(spark, sf, "events"), ["user_id"], "event_id", F.col("value"))
    return m.select("event_id", "n", F.round("mean", 8).alias("mean"), F.round("var", 7).alias("var"))


@query("""WITH p AS (SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM events GROUP BY 1), s AS (SELECT sum(n) AS tn, sum(v) AS tv FROM p)
SELECT round(0.5 * sum(abs(n / tn - v / tv)), 9) AS tv FROM p, s""")
def tv_distance(spark, sf):
    p = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    w = Window.partitionBy()  # one row for each event type
    p = p.withColumns({"p": F.col("n") / F.sum("n").over(w), "q": F.col("v") / F.sum("v").over(w)})
    return p.agg(F.round(T.total_variation(F.col("p"), F.col("q")), 9).alias("tv"))


@query("""WITH b AS (SELECT event_id % 1000 AS k, sum(value::DECIMAL(18,2)) AS p, count(*) AS q FROM events GROUP BY 1),
c AS (SELECT k, (sum(p) OVER (ORDER BY k))::DOUBLE / (sum(p) OVER ())::DOUBLE AS f, (sum(q) OVER (ORDER BY k))::DOUBLE / (sum(q) OVER ())::DOUBLE AS g FROM b)
SELECT round(sum(abs(f - g)), 6) AS mass FROM c""")
def cdf_mismatch(spark, sf):
    from embertide.operators.scan import running_sum

    b = table(spark, sf, "events").groupBy((F.col("event_id") % 1000).alias("k")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("p"), F.count(F.lit(1)).alias("q"))
    c = running_sum(running_sum(b, "k", F.col("p") * 100, "f"), "k", F.col("q"), "g")
    top = c.agg(F.max("f").alias("tf"), F.max("g").alias("tg"))
    c = c.crossJoin(F.broadcast(top))
    d = lambda a, b: F.col(a).cast("double") / F.col(b).cast("double")
    return c.agg(F.round(F.sum(F.abs(d("f", "tf") - d("g", "tg"))), 6).alias("mass"))


@query("""WITH RECURSIVE r(steps, b) AS (SELECT 0, 0.4::DOUBLE UNION ALL SELECT steps + 1, least(1.0::DOUBLE, b + (1.0::DOUBLE - b) * (steps + 1) / 100) FROM r WHERE steps < 10)
SELECT steps::BIGINT AS steps, round(b, 9) AS beta FROM r WHERE steps > 0""")
def beta_anneal(spark, sf):
    return spark.range(1, 11).select(F.col("id").alias("steps"), F.round(T.annealed_beta(0.4, 1.0, 100, F.col("id")), 9).alias("beta"))


@query("""WITH n AS (SELECT event_id, value, event_type = 'error' AS done, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nv FROM events)
SELECT event_id, round(value + 0.99 * nv * (CASE WHEN done THEN 0 ELSE 1 END) - value * 0.5, 6) + 0.0 AS td FROM n WHERE nv IS NOT NULL""")
def scalar_td_error(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = table(spark, sf, "events").withColumn("nv", F.lead("value").over(w)).where("nv is not null")
    return n.select("event_id", (F.round(T.td_error(F.col("value"), F.col("nv"), F.col("event_type") == "error", F.col("value") * 0.5), 6) + 0.0).alias("td"))


@query("""WITH p AS (SELECT event_id, value, value > 20 AS updated FROM events), c AS (SELECT 10 * median(value) FILTER (WHERE updated) AS cap FROM p)
SELECT event_id, least(value, cap) AS priority FROM p, c""")
def dataset_cap(spark, sf):
    e = table(spark, sf, "events")
    cap = e.agg((F.median(F.when(F.col("value") > 20, F.col("value"))) * 10).alias("cap"))
    return e.crossJoin(F.broadcast(cap)).select("event_id", F.least("value", "cap").alias("priority"))


@query("""WITH t AS (SELECT sum(value::DECIMAL(18,4))::DOUBLE AS a, sum((value::FLOAT)::DECIMAL(18,4))::DOUBLE AS b FROM events)
SELECT round(max(abs(value / a - value::FLOAT / b)), 9) AS worst, max(abs(value / a - value::FLOAT / b)) < 0.05 AS ok FROM events, t""")
def audit_tv(spark, sf):
    e = table(spark, sf, "events").withColumn("f", F.col("value").cast("float"))
    t = e.agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("a"), F.sum(F.col("f").cast("decimal(18,4)")).cast("double").alias("b"))
    gap = F.max(F.abs(F.col("value") / F.col("a") - F.col("f") / F.col("b")))
    return e.crossJoin(F.broadcast(t)).agg(F.round(gap, 9).alias("worst"), (gap < 0.05).alias("ok"))


@query("SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 100 GROUP BY 1")
def agg_last_100(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf, "events").withColumn("back", F.row_number().over(w)).where("back <= 100").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, (event_type = 'click')::INT || '' || (event_type = 'error')::INT || (event_type = 'purchase')::INT || (event_type = 'signup')::INT || (event_type = 'view')::INT AS onehot FROM events")
def array_one_hot(spark, sf):
    kinds = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(kinds, lambda k: (k == F.col("event_type")).cast("int").cast("string")), "").alias("onehot"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, array_to_string([greatest(x - (7 - l_linenumber) - 1, 0) FOR x IN range(1, 8)], ',') AS positions FROM lineitem""")
def array_position_ids(spark, sf):
    """Position ids of a left-padded row of seven whose mask has l_linenumber ones: clip(cumsum(mask) - 1, 0)."""
    n = F.col("l_linenumber")
    pos = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda x: F.greatest(x - (F.lit(7) - n) - 1, F.lit(0)).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(pos, ",").alias("positions"))
