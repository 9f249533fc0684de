"""Buffer lifecycle as set operations: eviction order, allocation, merge, refusal, quarantine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embertide.operators import state as S
from embertide.plans.w1_groups import rollouts
from embertide.plans.w2_sampling import NOW, STATE
from embertide.plans.w2_sampling import state as live
from embertide.session import table

QUERIES, ORACLE = {}, {}
CAPACITY = 4096


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def state(spark, sf):
    return live(spark, sf).withColumn("insert_seq", F.col("slot"))


@query(STATE + "SELECT slot, version FROM state ORDER BY version, slot LIMIT 100")
def topk_oldest(spark, sf):
    """The 100 entries that capacity takes first."""
    return S.oldest(state(spark, sf), 100).select("slot", "version")


@query(f"SELECT event_id AS slot FROM events WHERE {NOW} - date_diff('day', DATE '2024-01-01', ts::DATE) > 16 ORDER BY 1")
def sort_expired(spark, sf):
    return rollouts(spark, sf).where(F.lit(NOW) - F.col("version") > 16).select(F.col("event_id").alias("slot")).orderBy("slot")


@query(STATE + """, free AS (SELECT s AS slot, row_number() OVER (ORDER BY s) - 1 AS nth FROM range(20000) t(s) WHERE s NOT IN (SELECT slot FROM state)),
m AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS nth FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, slot FROM m JOIN free USING (nth)""")
def alloc_free_slots(spark, sf):
    """Each user's new entry takes the lowest free slot in turn; as many slots as entries and users always suffice."""
    users, held = table(spark, sf, "events").select("user_id").distinct(), state(spark, sf)
    return S.allocate(users, S.free_slots(held.count() + users.count(), held), "user_id").select("user_id", "slot")


@query(STATE + """, c AS (SELECT user_id AS slot, max_by(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY 1),
b AS (SELECT slot, state.q, state.version, c.op, c.seq FROM state FULL JOIN c USING (slot))
SELECT slot, CASE WHEN op IS NULL THEN q ELSE seq END AS q, CASE WHEN op IS NULL THEN version ELSE 29 END AS version
FROM b WHERE op IS NULL OR op <> 'error'""")
def merge_update(spark, sf):
    """The last event of a user writes, updates or (error) evicts the slot of its number."""
    ops = F.when(F.col("event_type") == "error", "evict").otherwise("write").alias("op")
    changes = table(spark, sf, "events").select(
        F.col("user_id").alias("slot"), ops, F.col("event_id").alias("q"), F.lit(NOW).cast("long").alias("version"), F.col("event_id").alias("seq"))
    return S.merge(state(spark, sf).select("slot", "q", "version"), changes)


@query(f"""WITH g AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS version, count(*) AS size FROM events GROUP BY 1),
t AS (SELECT *, sum(size) OVER (ORDER BY version)::BIGINT AS total FROM g)
SELECT version, size, greatest(total - {CAPACITY}, 0) - greatest(total - size - {CAPACITY}, 0) AS evicted FROM t""")
def capacity_evict(spark, sf):
    g = rollouts(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("size"))
    return S.capacity_evictions(g, CAPACITY).select("version", "size", "evicted")


@query("""WITH e AS (SELECT event_id, user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS version FROM events),
w AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM e)
SELECT event_id, seen - version AS late, seen - version > 2 AS refused FROM w""")
def late_refusal(spark, sf):
    """How far each record lags the newest version of its buffer, and whether that is too far."""
    w = Window.partitionBy("prompt_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    late = F.max("version").over(w) - F.col("version")
    return rollouts(spark, sf).select("event_id", late.alias("late")).withColumn("refused", F.col("late") > 2)


@query(STATE + "SELECT slot, source FROM state WHERE source = 'error' AND reward > 0.5 ORDER BY slot")
def quarantine_select(spark, sf):
    return S.quarantine(state(spark, sf), (F.col("source") == "error") & (F.col("reward") > 0.5)).select("slot", "source")


@query(STATE + "SELECT slot, prompt_id, source, q, version, leaf FROM state WHERE leaf > 0")
def state_lookup(spark, sf):
    """All live positions that can be drawn, with what they hold."""
    return state(spark, sf).where("leaf > 0").select("slot", "prompt_id", "source", "q", "version", F.col("leaf").cast("long").alias("leaf"))


@query("""WITH r AS (SELECT event_id % 1024 AS slot, max(event_id) AS event_id FROM events GROUP BY 1)
SELECT r.slot, event_id, user_id, event_type FROM r JOIN events USING (event_id)""")
def ring_contents(spark, sf):
    """A circular buffer of 1,024 after all events."""
    return S.ring(table(spark, sf, "events"), "event_id", 1024).select("slot", "event_id", "user_id", "event_type")


@query("""WITH w AS (SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS priority FROM events)
SELECT event_id, priority FROM w""")
def win_running_max(spark, sf):
    """New transitions enter at the greatest priority so far."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.max("value").over(w).alias("priority"))


@query("""SELECT source, count(*) AS n FROM (SELECT event_type AS source FROM events UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY 1""")
def set_union_sources(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_type").alias("source"))
    return a.unionByName(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def set_except(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'signup'").select("user_id").distinct().join(
        e.where("event_type = 'error'").select("user_id"), "user_id", "left_anti")


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'signup'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_lines FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_linenumber)")
def set_duplicates(spark, sf):
    """Groups in which a row number stands twice."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("distinct_lines"))
    return g.where("n > distinct_lines")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def rescore_first(spark, sf):
    """The first occurrence of each slot, which is rescored once."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
