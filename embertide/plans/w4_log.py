"""Questions over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertide.functions import exact as X
from embertide.operators import eventlog as L
from embertide.operators.scan import ranked
from embertide.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LOG = """WITH log AS (SELECT event_id AS ord, user_id AS slot, event_type AS kind, value,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'sample' WHEN 'error' THEN 'evict' WHEN 'view' THEN 'update' WHEN 'click' THEN 'advance_version' END AS op,
  date_diff('day', DATE '2024-01-01', ts::DATE) AS step FROM events),
chg AS (SELECT ord, slot, op FROM log WHERE op IN ('insert', 'evict')),
occ AS (SELECT s.ord, s.slot, s.step, CASE WHEN c.op = 'insert' THEN c.ord END AS insert_ord
  FROM (SELECT * FROM log WHERE op = 'sample') s ASOF LEFT JOIN chg c ON s.slot = c.slot AND s.ord > c.ord),
life AS (SELECT ord, slot, end_ord, end_op FROM (SELECT *, lead(ord) OVER w AS end_ord, lead(op) OVER w AS end_op FROM chg WINDOW w AS (PARTITION BY slot ORDER BY ord)) WHERE op = 'insert'),
win AS (SELECT *, (sum((op = 'advance_version')::INT) OVER (ORDER BY ord))::BIGINT AS win FROM log)
"""


def log(spark, sf):
    return L.log_of_events(table(spark, sf, "events"))


@query(LOG + "SELECT ord, slot, insert_ord FROM occ")
def join_asof_occupant(spark, sf):
    return L.occupants(log(spark, sf)).select("ord", "slot", "insert_ord")


@query(LOG + "SELECT ord, slot, end_ord, end_op FROM life")
def join_evicted_at(spark, sf):
    return L.lifetimes(log(spark, sf)).select("ord", "slot", "end_ord", "end_op")


@query(LOG + "SELECT ord, win FROM win")
def win_version_window(spark, sf):
    return L.version_windows(log(spark, sf)).select("ord", F.col("window").alias("win"))


@query(LOG + """SELECT i.ord AS insert_ord, i.slot, count(o.ord) AS times, min(o.ord) AS first_ord, max(o.ord) AS last_ord
FROM (SELECT * FROM log WHERE op = 'insert') i LEFT JOIN occ o ON o.insert_ord = i.ord GROUP BY ALL""")
def agg_exposure(spark, sf):
    return L.exposure(log(spark, sf)).select("insert_ord", "slot", "times", "first_ord", "last_ord")


def _sources(spark, sf):
    lg = log(spark, sf)
    own = lg.where("op = 'insert'").withColumn("source", F.when(F.col("value") > 20, F.expr("cast(slot % 5 as string)")))
    drawn = L.occupants(lg).where("insert_ord is not null").select("insert_ord").join(own.select(F.col("ord").alias("insert_ord"), "source"), "insert_ord")
    return own, drawn


MIX = LOG + """, own AS (SELECT ord, CASE WHEN value > 20 THEN (slot % 5)::VARCHAR END AS source FROM log WHERE op = 'insert'),
a AS (SELECT coalesce(source, '(none)') AS source, count(*) AS inserted FROM own GROUP BY 1),
b AS (SELECT coalesce(source, '(none)') AS source, count(*) AS sampled FROM occ JOIN own ON insert_ord = own.ord GROUP BY 1),
mix AS (SELECT source, coalesce(inserted, 0) AS inserted, coalesce(sampled, 0) AS sampled FROM a FULL JOIN b USING (source))
"""


@query(MIX + "SELECT source, inserted, sampled, sampled / sum(sampled) OVER () AS share FROM mix")
def agg_mixture(spark, sf):
    return L.mixture(*_sources(spark, sf))


@query(MIX + """, quota AS (SELECT * FROM (VALUES ('0', 10), ('1', 100000), ('(none)', 5), ('absent', 0)) v(source, allowed))
SELECT source, allowed::BIGINT AS allowed, coalesce(sampled, 0) AS sampled, sampled IS NOT NULL AS present, coalesce(sampled, 0) <= allowed AS ok
FROM quota LEFT JOIN mix USING (source)""")
def quota_verdicts(spark, sf):
    quotas = spark.createDataFrame([("0", 10), ("1", 100000), ("(none)", 5), ("absent", 0)], "source string, allowed long")
    return L.quota_verdicts(L.mixture(*_sources(spark, sf)), quotas)


@query(LOG + "SELECT win, op, count(*) AS n FROM win GROUP BY ALL")
def agg_window_mixture(spark, sf):
    return L.version_windows(log(spark, sf)).groupBy(F.col("window").alias("win"), "op").agg(F.count(F.lit(1)).alias("n"))


@query(LOG + "SELECT slot, count(*) AS draws FROM log WHERE op = 'sample' GROUP BY 1")
def agg_slot_draws(spark, sf):
    return log(spark, sf).where("op = 'sample'").groupBy("slot").agg(F.count(F.lit(1)).alias("draws"))


@query(LOG + "SELECT ord, slot FROM occ WHERE insert_ord IN (SELECT min(ord) FROM chg WHERE op = 'insert' GROUP BY slot)")
def find_digest(spark, sf):
    """Every draw of the first example of each slot."""
    lg = log(spark, sf)
    asked = lg.where("op = 'insert'").groupBy("slot").agg(F.min("ord").alias("insert_ord")).select("insert_ord")
    return L.occupants(lg).join(asked, "insert_ord", "left_semi").select("ord", "slot")


@query(LOG + """SELECT i.slot, count(DISTINCT i.ord) AS inserts, count(o.ord) AS times, count(DISTINCT o.step) AS steps
FROM (SELECT * FROM log WHERE op = 'insert') i LEFT JOIN occ o ON o.insert_ord = i.ord GROUP BY 1""")
def blast_radius(spark, sf):
    """What the examples of each slot have touched."""
    lg = log(spark, sf)
    own = lg.where("op = 'insert'").select("slot", F.col("ord").alias("insert_ord"))
    hits = L.occupants(lg).where("insert_ord is not null").select("insert_ord", F.col("ord").alias("hit"), "step")
    return own.join(hits, "insert_ord", "left").groupBy("slot").agg(
        F.countDistinct("insert_ord").alias("inserts"), F.count("hit").alias("times"), F.countDistinct("step").alias("steps"))


@query("""SELECT l_orderkey, r AS row FROM (SELECT l_orderkey, unnest(range(1, 8)) AS r FROM lineitem GROUP BY 1)
EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem""")
def replay_fresh_rows(spark, sf):
    """Rows 1 to 7 of each step that nothing is bound to."""
    li = table(spark, sf, "lineitem")
    rows = li.select("l_orderkey").distinct().withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(7))))
    bound = li.select("l_orderkey", F.col("l_linenumber").alias("row"))
    return rows.join(bound, ["l_orderkey", "row"], "left_anti").withColumn("row", F.col("row").cast("long"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def steps_without_witness(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(LOG + "SELECT o.ord, o.step, count(i.ord) AS generated FROM occ o LEFT JOIN (SELECT * FROM log WHERE op = 'insert') i ON i.step = o.step AND i.ord < o.ord GROUP BY ALL")
def join_generated_examples(spark, sf):
    """Inserts of a sample's step before it: a running count inside the step."""
    from pyspark.sql import Window

    w = Window.partitionBy("step").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum((F.col("op") == "insert").cast("int")).over(w), F.lit(0)).alias("generated")
    return log(spark, sf).select("ord", "step", "op", n).where("op = 'sample'").select("ord", "step", "generated")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS declared FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, count(*) AS placed FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(declared, 0) AS declared, coalesce(placed, 0) AS placed FROM a FULL JOIN b USING (l_orderkey, l_linenumber)
WHERE coalesce(declared, 0) <> 1 OR coalesce(placed, 0) <> 1""")
def witness_coverage(spark, sf):
    li = table(spark, sf, "lineitem")
    return L.uncovered(li.where("l_quantity > 10"), li.where("l_tax > 0.02"), ["l_orderkey", "l_linenumber"])


@query("""SELECT event_id AS ord, 'value' AS fields FROM events WHERE event_id >= 1234 AND value <> 1 ORDER BY 1 LIMIT 1""")
def diff_first_difference(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_id").alias("ord"), "user_id", "value")
    b = a.withColumn("value", F.when(F.col("ord") >= 1234, 1.0).otherwise(F.col("value")))
    return L.first_difference(a, b, "ord", ["user_id", "value"])


@query("""WITH o AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)
SELECT a.user_id, min(a.nth) AS nth FROM o a JOIN o b ON b.user_id = a.user_id + 1 AND b.nth = a.nth AND a.event_type <> b.event_type GROUP BY 1""")
def diff_logs_of_users(spark, sf):
    """Where the log of each user first differs in kind from the next user's."""
    from pyspark.sql import Window

    o = table(spark, sf, "events").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    a = o.select("user_id", "nth", "event_type")
    b = o.select((F.col("user_id") - 1).alias("user_id"), "nth", F.col("event_type").alias("other"))
    return a.join(b, ["user_id", "nth"]).where("event_type <> other").groupBy("user_id").agg(F.min("nth").alias("nth"))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS nth, p_size FROM part),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS nth FROM supplier)
SELECT nth, p_partkey, s_suppkey FROM p FULL JOIN s USING (nth)""")
def join_positional(spark, sf):
    """The i-th line of one list with the i-th of the other."""
    p = ranked(table(spark, sf, "part").select("p_partkey"), "p_partkey", "nth")
    s = ranked(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "nth")
    return p.join(s, "nth", "full").select("nth", "p_partkey", "s_suppkey")


@query("""SELECT a.l_orderkey, a.l_partkey, b.l_partkey AS other FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey""")
def join_prompt_siblings(spark, sf):
    """Examples that share a prompt."""
    one = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return one.join(one.select("l_orderkey", F.col("l_partkey").alias("other")), "l_orderkey").where("l_partkey < other")


@query("""SELECT o_orderkey, max_by(l_partkey, (l_linenumber, l_partkey)) AS last_part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def join_last_line_wins(spark, sf):
    """A key's example is the last line that opens it."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("last_part"))
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left")


@query("""WITH d AS (SELECT event_id, sha256(event_id || ':' || event_type) AS digest FROM events),
c AS (SELECT event_id, digest, CASE WHEN event_id % 1000 = 7 THEN 'x' ELSE coalesce(lag(digest) OVER (ORDER BY event_id), 'genesis') END AS prev_digest FROM d)
SELECT event_id AS ord FROM (SELECT *, coalesce(lag(digest) OVER (ORDER BY event_id), 'genesis') AS want FROM c) WHERE prev_digest <> want""")
def check_prev_link(spark, sf):
    """A chain with a broken link at every thousandth record: found by blocks of the order, not in one task."""
    d = table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.sha2(F.concat_ws(":", "event_id", "event_type"), 256).alias("digest"))
    d = ranked(d, "ord", "nth")
    before = d.select((F.col("nth") + 1).alias("nth"), F.col("digest").alias("want"))
    c = d.join(before, "nth", "left").withColumn("want", F.coalesce("want", F.lit("genesis")))
    c = c.withColumn("prev_digest", F.when(F.col("ord") % 1000 == 7, F.lit("x")).otherwise(F.col("want")))
    return c.where("prev_digest <> want").select("ord")


@query()
def record_digest(spark, sf):
    """Chain digests of the log's records, as the log spells them."""
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("index"), F.col("event_type").alias("op"))).alias("raw"))
    return e.select("event_id", X.record_digest_udf("raw").alias("digest"))


@query("""SELECT event_id, json_keys(props) = ['k'] AS known FROM events""")
def check_known_keys(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", (F.size(F.array_except(keys, F.array(F.lit("k")))) == 0).alias("known"))


@query(LOG + """, iv AS (SELECT ord AS a, coalesce(end_ord, 1e15::BIGINT) AS b FROM life)
SELECT s.ord, count(iv.a) AS live FROM (SELECT ord FROM log WHERE op = 'sample') s LEFT JOIN iv ON iv.a < s.ord AND s.ord < iv.b GROUP BY 1""")
def win_live_set(spark, sf):
    """Live entries at each sample: +1 at an insert into an empty slot, -1 at the evict that empties it, summed by a scan."""
    from pyspark.sql import Window

    from embertide.operators.scan import running_sum

    lg = log(spark, sf)
    w = Window.partitionBy("slot").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("op").isin("insert", "evict"), F.col("op")), ignorenulls=True).over(w), F.lit("evict"))
    change = F.when((F.col("op") == "insert") & (held == "evict"), 1).when((F.col("op") == "evict") & (held == "insert"), -1).otherwise(0)
    return running_sum(lg.withColumn("d", change), "ord", F.col("d"), "live", kind="bigint").where("op = 'sample'").select("ord", "live")
