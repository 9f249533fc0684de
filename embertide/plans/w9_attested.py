"""Queries over a log that attests to its buffer: mutations, draws, witnesses, and the checks of their fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions import exact as X
from embertide.functions.decay import Decay, decay_table, leaf, quantize
from embertide.operators import batches as B
from embertide.operators import eventlog as L
from embertide.operators import replay as R
from embertide.operators import sampling as S
from embertide.operators import verify as V
from embertide.operators.scan import ranked, span_of
from embertide.plans.w2_sampling import STATE, state
from embertide.plans.w4_log import LOG, log
from embertide.plans.w5_batches import DECIDED, decided
from embertide.plans.w6_experiments import RUNS, runs
from embertide.session import cut, table
from embertide.sources.logs import LOG_SCHEMA

QUERIES, ORACLE = {}, {}
DECAY = Decay(half_life=4, max_age=16, capacity=1 << 20)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Events as an attested log of 17 versions: signup and view write the slot of their user (update where it is live), error evicts it,
#: purchase samples two slots, click witnesses the last purchase. Some declared values are wrong, at fixed remainders of the order.
_T = ", ".join(map(str, decay_table(DECAY.half_life)))
LEAF = f"((({{q}})::HUGEINT * ([{_T}])[({{t}}) % 4 + 1]) // 2147483648 * pow(2, ({{t}}) // 4)::HUGEINT)"
ATTESTED = f"""WITH n AS (SELECT max(event_id) // 16 + 1 AS w FROM events),
ev AS (SELECT event_id AS ord, user_id AS slot, event_type, event_id // w AS version,
  (CASE WHEN value = 0 THEN 0 ELSE greatest(1, floor(value / 100 * 65536)) END)::BIGINT AS q FROM events, n),
m0 AS (SELECT *, event_type <> 'error' AS writes, coalesce(lag(event_type <> 'error') OVER (PARTITION BY slot ORDER BY ord), false) AS live
  FROM ev WHERE event_type IN ('signup', 'view', 'error')),
m1 AS (SELECT ord, slot, version AS t, q, live, CASE WHEN writes AND live THEN 'update' WHEN writes THEN 'insert' WHEN live THEN 'evict' END AS op FROM m0),
m2 AS (SELECT *, lag(q) OVER s AS pq, lag(t) OVER s AS pt, lead(ord) OVER s AS stop FROM m1 WHERE op IS NOT NULL WINDOW s AS (PARTITION BY slot ORDER BY ord)),
mut AS (SELECT *, CASE WHEN live THEN {LEAF.format(q='pq', t='pt')} ELSE 0 END AS old, CASE WHEN op <> 'evict' THEN {LEAF.format(q='q', t='t')} ELSE 0 END AS new FROM m2),
iv AS (SELECT slot, ord AS start, stop, new AS leaf FROM mut WHERE op <> 'evict'),
d AS (SELECT ord, k, CASE k WHEN 0 THEN slot ELSE slot * 7 % 1000 END AS slot, (ord * 2654435761 % 1048576 * 65536)::BIGINT * (k + 1) AS draw FROM ev, (VALUES (0), (1)) x(k) WHERE event_type = 'purchase')
"""


def attested(spark, sf):
    """ord 1 is the configuration; event e stands at 2 e + 5, the advance to version v at 2 v w + 4."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    most = e.agg(F.max("event_id")).first()[0]
    w = (most or 0) // 16 + 1
    at = lambda x: (x * 2 + 5).cast("long")
    own = e.select("event_id", at(F.col("event_id")).alias("ord"), F.col("user_id").alias("slot"), "event_type", F.floor(F.col("event_id") / w).alias("version"), quantize(F.col("value") / 100).alias("q"))
    by = Window.partitionBy("slot").orderBy("ord")
    writes = F.col("event_type") != "error"
    m = own.where("event_type in ('signup', 'view', 'error')").withColumn("live", F.coalesce(F.lag(writes).over(by), F.lit(False)))
    m = m.withColumn("op", F.when(writes & F.col("live"), "update").when(writes, "insert").when(F.col("live"), "evict")).where("op is not null")
    m = m.withColumns({"pq": F.lag("q").over(by), "pt": F.lag("version").over(by)})
    evict = F.col("op") == "evict"
    wide = lambda q, t: leaf(F.col(q), F.col(t), 0, DECAY.half_life).cast("decimal(38,0)")
    wrong = lambda by, rest: (F.col("event_id") % by == rest).cast("int")
    old = F.when(F.col("live"), wide("pq", "pt")).otherwise(0).cast("decimal(38,0)") + wrong(97, 5)
    new = F.when(evict, 0).otherwise(wide("q", "version")).cast("decimal(38,0)") + wrong(89, 3)
    text = lambda c: c.cast("string")
    m = m.select(
        "ord", "op", text(F.col("ord")).alias("op_counter"), text(F.col("slot")).alias("index"), text(old).alias("old_priority_int"), text(new).alias("new_priority_int"),
        text(F.when(evict, F.col("pq")).otherwise(F.col("q"))).alias("base_priority_int"), text(F.when(evict, F.col("pt")).otherwise(F.col("version"))).alias("entry_version"),
        text(wrong(73, 4)).alias("base_epoch"), F.when(evict, F.when(F.col("event_id") % 83 == 1, "whim").otherwise("explicit")).alias("reason"),
        F.when(F.col("op") == "insert", F.sha2(text(F.col("ord")), 256)).alias("content_digest"), F.when(F.col("op") == "insert", text(F.col("slot") % 5)).alias("source"),
    )
    draw = (F.col("event_id") * 2654435761 % 1048576) * 65536
    one = lambda k, slot: F.struct(text(slot).alias("leaf_index"), text(draw * (k + 1)).alias("draw_int"), *(F.lit("1").alias(n) for n in ("prob_num", "prob_den", "is_weight_num", "is_weight_den")))
    s = own.where("event_type = 'purchase'").select("ord", F.lit("sample").alias("op"), text(F.col("ord")).alias("op_counter"), F.lit("0").alias("root_total"), F.array(one(0, F.col("slot")), one(1, F.col("slot") * 7 % 1000)).alias("samples"))
    s = s.withColumn("samples", F.from_json(F.to_json("samples"), LOG_SCHEMA["samples"].dataType))
    b = own.where("event_type = 'click'").select("ord", "event_id")
    v = spark.range(1, 17).select((F.col("id") * 2 * w + 4).alias("ord"), F.lit("advance_version").alias("op"), text(F.col("id") - 1).alias("old_version"), text(F.col("id")).alias("new_version"))
    v = v.where(F.col("ord") <= 2 * (most or 0) + 5)
    c = spark.range(1).select(F.lit(1).cast("long").alias("ord"), F.lit("decay_config").alias("op"), F.lit("4").alias("half_life"), F.lit("16").alias("max_policy_age"), F.lit(str(DECAY.capacity)).alias("capacity"), F.lit("0").alias("rebase_slack"), F.lit("true").alias("reset_age_on_update"))
    none = spark.createDataFrame([], T.StructType([T.StructField("ord", T.LongType()), *LOG_SCHEMA.fields]))
    out = none
    for part in (c, v, m, s):
        out = out.unionByName(part, allowMissingColumns=True)
    return out, b


def witnesses(b, out):
    """The witness of each click: draws of the last purchase before it fill rows 0 and 2 of four."""
    place = lambda row, k: F.struct(F.lit(str(row)).alias("row"), F.lit(str(k)).alias("draw"), F.lit(None).cast("string").alias("content_digest"))
    both = out.where("op = 'sample'").select("ord", F.lit(1).alias("one")).unionByName(b.select("ord", F.lit(0).alias("one")))
    from embertide.operators.scan import running_sum

    told = running_sum(both, "ord", F.col("one"), "nth", kind="bigint")
    last = told.where("one = 1").select("nth", F.col("ord").alias("sample_ord"))
    rows = told.where("one = 0").join(last, "nth")
    return rows.select("ord", F.lit("batch").alias("op"), F.col("ord").cast("string").alias("step"), F.col("sample_ord").cast("string").alias("sample_op_counter"), F.lit("4").alias("batch_rows"), F.array(place(0, 0), place(2, 1)).alias("replaced"))


@query(ATTESTED + """SELECT ord, 'old value' AS problem FROM mut WHERE ord % 97 = 5 UNION ALL SELECT ord, 'new value' FROM mut WHERE ord % 89 = 3
UNION ALL SELECT ord, 'base epoch' FROM mut WHERE ord % 73 = 4 UNION ALL SELECT ord, 'reason unknown' FROM mut WHERE op = 'evict' AND ord % 83 = 1""")
def verify_mutations(spark, sf):
    """Declared leaves, epochs and reasons against what each slot held."""
    out, _ = attested(spark, sf)
    moved = R.mutations(R.clock(out), DECAY)
    return V.mutation_problems(moved, DECAY, reset=True).select(F.floor((F.col("ord") - 5) / 2).alias("ord"), "problem")


@query(ATTESTED + """SELECT d.ord, d.k, any_value(d.slot) AS slot, coalesce(sum(leaf) FILTER (WHERE iv.slot < d.slot), 0)::DOUBLE AS lo, coalesce(sum(leaf) FILTER (WHERE iv.slot = d.slot), 0)::DOUBLE AS leaf,
 coalesce(sum(leaf), 0)::DOUBLE AS total, count(iv.slot) AS live, (min(leaf) FILTER (WHERE leaf > 0))::DOUBLE AS least,
 any_value(draw) >= coalesce(sum(leaf) FILTER (WHERE iv.slot < d.slot), 0) AND any_value(draw) < coalesce(sum(leaf) FILTER (WHERE iv.slot <= d.slot), 0) AS hit
FROM d LEFT JOIN iv ON start < d.ord AND (stop IS NULL OR d.ord < stop) GROUP BY d.ord, d.k""")
def verify_samples(spark, sf):
    """Each draw in the live set it was made from: the interval of its slot, total, count and least leaf, and whether it lies there."""
    out, _ = attested(spark, sf)
    out = cut(out, "log")
    span = span_of(out, "ord")
    clocked = cut(R.clock(out, span), "clock")
    st = V.sample_state(clocked, cut(R.mutations(clocked, DECAY), "mutations"), span)
    real = lambda c: F.col(c).cast("double").alias(c)
    return st.select(F.floor((F.col("ord") - 5) / 2).alias("ord"), "k", "slot", real("lo"), real("leaf"), real("total"), F.col("live_entries").alias("live"), real("least"),
                     ((F.col("lo") <= F.col("draw")) & (F.col("draw") < F.col("hi"))).alias("hit"))


@query(ATTESTED + """, b AS (SELECT c.ord, s.ord AS sample_ord FROM (SELECT ord FROM ev WHERE event_type = 'click') c ASOF JOIN (SELECT ord FROM ev WHERE event_type = 'purchase') s ON c.ord > s.ord),
r AS (SELECT ord AS step, sample_ord, row, CASE row WHEN 0 THEN 0 WHEN 2 THEN 1 END AS draw FROM b, (VALUES (0), (1), (2), (3)) x(row)),
src AS (SELECT slot, ord, op, max(CASE WHEN op = 'insert' THEN ord END) OVER (PARTITION BY slot ORDER BY ord) AS ins FROM mut)
SELECT r.step, r.row, CASE WHEN r.draw IS NULL THEN 'fresh' ELSE 'replayed' END AS kind, r.draw, d.slot, CASE WHEN src.op <> 'evict' THEN src.slot % 5 END AS source
FROM r LEFT JOIN d ON d.ord = r.sample_ord AND d.k = r.draw ASOF LEFT JOIN src ON src.slot = d.slot AND r.sample_ord > src.ord""")
def explain_row(spark, sf):
    """Why each row of each witnessed batch holds what it holds."""
    out, b = attested(spark, sf)
    out = cut(out, "log")
    w = witnesses(b, out)
    rows = w.select(F.col("step").cast("long").alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("row"))
    told = V.explain_rows(out.unionByName(w, allowMissingColumns=True), rows)
    return told.select(F.floor((F.col("step") - 5) / 2).alias("step"), "row", "kind", "draw", "slot", F.col("source").cast("long").alias("source"))


@query("""WITH w AS (SELECT l_suppkey, (1 / (1 + l_quantity))::DOUBLE AS w FROM lineitem) SELECT l_suppkey, round(pow(sum(w), 2) / sum(w * w), 5) AS ess FROM w GROUP BY 1""")
def agg_ess_exact(spark, sf):
    """Effective size over exact rationals, by supplier."""
    li = table(spark, sf, "lineitem").select("l_suppkey", F.lit(1).cast("long").alias("num"), (1 + F.col("l_quantity")).cast("long").alias("den"))
    return S.exact_ess(li, ["l_suppkey"], "num", "den").select("l_suppkey", F.round("ess", 5).alias("ess"))


@query(STATE + "SELECT count(*) AS n, 0::BIGINT AS falls, (SELECT sum(leaf) FROM state)::DOUBLE AS total, max(cum_after)::DOUBLE AS last FROM scan")
def check_prefix(spark, sf):
    """The running sum never falls and ends in the total."""
    st = state(spark, sf)
    p = S.prefix(st)
    t = st.agg(F.sum("leaf").cast("double").alias("total"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("leaf") < 0).alias("falls"), F.max("cum_after").cast("double").alias("last")).crossJoin(F.broadcast(t))


@query(r"SELECT conv_id, turn, regexp_full_match(text, '(?:[^\p{C}\p{Z}]|\x20)+') AND length(text) <= 256 AND trim(text) <> '' AS ok FROM conversations")
def check_text_shape(spark, sf):
    """Printable texts of at most 256 characters that aren't blank: the rule for sources and notes."""
    return table(spark, sf, "conversations").select("conv_id", "turn", V.printable(F.col("text"), V.SOURCE_CHARS).alias("ok"))


@query("""SELECT event_id, event_id % 7 <> 0 AND value < 300 AS ok FROM events""")
def check_reward_map(spark, sf):
    """Reward maps: printable names, finite numbers; an empty map is fine."""
    e = table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("value") >= 300, F.lit(float("inf"))).otherwise(F.col("value"))
    return e.select("event_id", B.valid_rewards(F.create_map(F.lit("verifier"), F.col("value"), F.col("event_type"), odd)).alias("ok"))


@query("""WITH r AS (SELECT event_id, event_type = 'signup' AS ins, event_id % 10 <> 0 AS dig, event_id % 4 = 0 AS src FROM events)
SELECT count(*) FILTER (WHERE dig AND NOT ins) AS digest_off_an_insert, count(*) FILTER (WHERE src AND NOT dig) AS source_without_digest,
 count(*) FILTER (WHERE ins AND dig) > 0 AND count(*) FILTER (WHERE ins AND NOT dig) > 0 AS mixed FROM r""")
def check_content_fields(spark, sf):
    """A digest only on inserts, a source only with a digest, and all inserts alike."""
    e = table(spark, sf, "events").select((F.col("event_type") == "signup").alias("ins"), (F.col("event_id") % 10 != 0).alias("dig"), (F.col("event_id") % 4 == 0).alias("src"))
    ins, dig, src = F.col("ins"), F.col("dig"), F.col("src")
    return e.agg(F.count_if(dig & ~ins).alias("digest_off_an_insert"), F.count_if(src & ~dig).alias("source_without_digest"), ((F.count_if(ins & dig) > 0) & (F.count_if(ins & ~dig) > 0)).alias("mixed"))


@query("""WITH m AS (SELECT vec_id, [x > 0 FOR x IN embedding[1:6]] AS m FROM embeddings), c AS (SELECT vec_id, m, len(list_filter(m, lambda x: x)) AS n FROM m)
SELECT vec_id, n, m = [i <= n FOR i IN range(1, len(m) + 1)] AS prefix, m = [i > len(m) - n FOR i IN range(1, len(m) + 1)] AS suffix FROM c""")
def array_mask_runs(spark, sf):
    """Masks that are one run of ones at the start, or at the end."""
    m = F.transform(F.slice("embedding", 1, 6), lambda x: x > 0)
    n, prefix, suffix = B.mask_run(m)
    return table(spark, sf, "embeddings").select("vec_id", n.cast("long").alias("n"), prefix.alias("prefix"), suffix.alias("suffix"))


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0 AND x <= 0.02)) AS clamped, len(list_filter(embedding, lambda x: x > 0.02)) > 0 AS refused,
 round(list_sum([least(x::DOUBLE, 0) FOR x IN embedding]), 6) + 0.0 AS total FROM embeddings""")
def array_clamp_logprobs(spark, sf):
    """Log-probabilities just over 0 become 0 and are counted; larger ones are refused."""
    kept, clamped, refused = B.clamp_logprobs(F.col("embedding"), 0.02)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.least(x.cast("double"), F.lit(0.0)))
    return table(spark, sf, "embeddings").select("vec_id", clamped.cast("long").alias("clamped"), refused.alias("refused"), (F.round(total, 6) + 0.0).alias("total"))


@query("""WITH t AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(x[greatest(len(x) - 2, 1):], ',') AS prompt, array_to_string(x[1:2], ',') AS completion FROM t""")
def array_unpad(spark, sf):
    """The last three ids of a left-padded row, the first two of a right-padded one."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: s.l_partkey)
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids.alias("x"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return t.select("l_orderkey", join(B.unpad(F.col("x"), F.least(F.size("x"), F.lit(3)), left=True)).alias("prompt"), join(B.unpad(F.col("x"), F.lit(2))).alias("completion"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4""")
def filter_shard(spark, sf):
    """Rows 2 to 4 of each batch."""
    return B.shard(table(spark, sf, "lineitem"), "l_linenumber", 2, 5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey % 10 = 0""")
def join_witness_draws(spark, sf):
    """Witness entries whose example isn't the one their draw selected."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    drawn = li.distinct().withColumn("digest", F.sha2(F.col("l_partkey").cast("string"), 256))
    placed = li.withColumn("claimed", F.sha2(F.when(F.col("l_suppkey") % 10 == 0, F.lit("x")).otherwise(F.col("l_partkey").cast("string")), 256))
    return L.disagreeing(placed, drawn, keys, "claimed", "digest").select(*keys)


@query("""SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS declined, count(l_orderkey) = 0 AS unwitnessed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def join_unwitnessed(spark, sf):
    """Samples without a witness, and declined draws of the others."""
    o, li = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    told = li.groupBy("o_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("declined"))
    return o.join(told, "o_orderkey", "left").select("o_orderkey", F.coalesce("declined", F.lit(0)).alias("declined"), F.col("declined").isNull().alias("unwitnessed"))


@query(LOG + """, p AS (SELECT ord, slot, insert_ord, lag(insert_ord) OVER (PARTITION BY slot ORDER BY ord) AS before, lag(ord) OVER (PARTITION BY slot ORDER BY ord) AS last FROM occ)
SELECT ord, slot, last, before IS NOT DISTINCT FROM insert_ord AS valid FROM p WHERE last IS NOT NULL""")
def join_last_batch(spark, sf):
    """Whether a slot still holds, at its next draw, the example of the draw before."""
    w = Window.partitionBy("slot").orderBy("ord")
    o = L.occupants(log(spark, sf)).withColumns({"before": F.lag("insert_ord").over(w), "last": F.lag("ord").over(w)})
    return o.where("last is not null").select("ord", "slot", "last", F.col("before").eqNullSafe(F.col("insert_ord")).alias("valid"))


@query("""WITH s AS (SELECT user_id AS slot, count(*) AS n, max(event_id) AS seq FROM events GROUP BY 1)
SELECT slot, slot // 8 AS grp, slot % 8 AS member, n > 1 AS duplicate, seq FROM s""")
def join_snapshot_slots(spark, sf):
    """Slots of a snapshot resolved to group and member, those named more than once marked."""
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("seq"))
    return s.select("slot", F.floor(F.col("slot") / 8).alias("grp"), (F.col("slot") % 8).alias("member"), (F.col("n") > 1).alias("duplicate"), "seq")


@query(LOG + """, s AS (SELECT DISTINCT (slot % 3)::VARCHAR AS source FROM log), v AS (SELECT DISTINCT win FROM win),
c AS (SELECT win, (slot % 3)::VARCHAR AS source, count(*) AS n FROM win WHERE op = 'sample' GROUP BY ALL)
SELECT win, source, coalesce(n, 0) AS sampled FROM v CROSS JOIN s LEFT JOIN c USING (win, source)""")
def agg_window_sources(spark, sf):
    """Draws by version window and source, windows without any kept: windows times the few sources of the log."""
    lg = L.version_windows(log(spark, sf)).withColumn("source", (F.col("slot") % 3).cast("string"))
    drawn = lg.where("op = 'sample'").groupBy(F.col("window").alias("win"), "source").agg(F.count(F.lit(1)).alias("n"))
    names = lg.agg(F.sort_array(F.collect_set("source")).alias("names"))  # one row, bounded by the sources a log declares
    every = lg.select(F.col("window").alias("win")).distinct().crossJoin(F.broadcast(names)).select("win", F.explode("names").alias("source"))
    return every.join(drawn, ["win", "source"], "left").select("win", "source", F.coalesce("n", F.lit(0)).alias("sampled"))


@query("""SELECT event_type AS category, count(*) AS total, count(*) FILTER (WHERE value > 20) AS rejected, count(*) FILTER (WHERE value <= 20) AS survived FROM events GROUP BY 1""")
def agg_campaign(spark, sf):
    """Outcomes of a mutation campaign by category."""
    e, hit = table(spark, sf, "events"), F.col("value") > 20
    return e.groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("rejected"), F.count_if(~hit).alias("survived"))


@query(LOG + "SELECT step, count(*) FILTER (WHERE op = 'sample') AS samples, count(*) FILTER (WHERE op = 'update') AS telemetry, count(DISTINCT slot) FILTER (WHERE op = 'sample') AS witnesses FROM log GROUP BY 1")
def agg_telemetry_counts(spark, sf):
    lg, sample = log(spark, sf), F.col("op") == "sample"
    return lg.groupBy("step").agg(F.count_if(sample).alias("samples"), F.count_if(F.col("op") == "update").alias("telemetry"), F.countDistinct(F.when(sample, F.col("slot"))).alias("witnesses"))


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS policy FROM events),
f AS (SELECT *, first_value(policy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM p)
SELECT event_id, first IS NOT NULL AND policy IS NULL AS left_out, coalesce(policy <> first, false) AS changed FROM f WHERE (first IS NOT NULL AND policy IS NULL) OR policy <> first""")
def win_policy_persists(spark, sf):
    """Records that leave out a policy declared earlier, or change it."""
    e = table(spark, sf, "events").withColumn("policy", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return L.not_persisting(e, ["user_id"], "event_id", "policy").select("event_id", "left_out", "changed")


@query(RUNS + """, o AS (SELECT * FROM (VALUES ('MACHINERY', 0), ('BUILDING', 1), ('AUTOMOBILE', 2), ('FURNITURE', 3), ('HOUSEHOLD', 4)) v(arm, place)),
a AS (SELECT DISTINCT arm, seed FROM run) SELECT arm, seed, row_number() OVER (ORDER BY place, seed) AS nth FROM a JOIN o USING (arm)""")
def sort_arms(spark, sf):
    """Arms in declared order, then seeds; the grid has a row for each arm and seed."""
    names = ["MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    place = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    a = runs(spark, sf).select("arm", "seed").distinct().withColumn("place", F.try_element_at(place, "arm")).where("place is not null")
    return a.select("arm", "seed", F.row_number().over(Window.orderBy("place", "seed")).cast("long").alias("nth"))


@query("""WITH s AS (SELECT l_linenumber % 2 AS rank, l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY ALL), w AS (SELECT max(len(x)) AS w FROM s)
SELECT rank, l_orderkey, len(x) AS n, len(list_concat(x, [0 FOR i IN range(w - len(x))])) AS width FROM s, w""")
def set_union_shards(spark, sf):
    """Shards one after another by rank, rows padded to the widest."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: s.l_partkey)
    li = table(spark, sf, "lineitem").withColumn("rank", F.col("l_linenumber") % 2)
    shards = [li.where(F.col("rank") == r).groupBy("l_orderkey").agg(ids.alias("x")) for r in (0, 1)]
    u = B.union_shards(shards, "x", 0)
    return u.select("rank", "l_orderkey", F.col("n").cast("long").alias("n"), F.size("x").cast("long").alias("width"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS first_round FROM events GROUP BY 1""")
def set_union_rounds(spark, sf):
    """Generation rounds under one another, which must have the same columns, counted again."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    u = B.union_rounds([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])
    return u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("round") == 0).alias("first_round"))


@query(RUNS + """, k AS (SELECT arm, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM (SELECT DISTINCT arm, seed FROM run) GROUP BY 1)
SELECT arm, seeds, (SELECT count(DISTINCT seeds) FROM k) = 1 AS same FROM k""")
def set_same_seeds(spark, sf):
    """Whether all arms ran the same seeds."""
    k = runs(spark, sf).groupBy("arm").agg(F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds"))
    same = k.agg((F.countDistinct("seeds") == 1).alias("same"))  # one row
    return k.crossJoin(F.broadcast(same))


@query("""SELECT l_linenumber AS step, round(greatest(0.1, 1.0 - (1.0 - 0.1) * l_linenumber / 5), 9) AS epsilon, greatest(1, l_linenumber // 2)::BIGINT AS half_life FROM lineitem GROUP BY 1""")
def scalar_schedules(spark, sf):
    """The linear exploration schedule and the half life that follows from a policy age."""
    s = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("step")).distinct()
    return s.select("step", F.round(B.linear_schedule(F.col("step"), 1.0, 0.1, 5), 9).alias("epsilon"), F.greatest(F.lit(1), F.floor(F.col("step") / 2)).cast("long").alias("half_life"))


@query(DECIDED + "SELECT step, count(*) FILTER (WHERE reason IS NULL) AS kept, count(reason) AS declined, count(*) FILTER (WHERE reason IS NULL AND scale < 1) AS rescaled, round(sum((w * scale * 0.5)::DECIMAL(28,12)) FILTER (WHERE reason IS NULL)::DOUBLE, 6) AS mass FROM dec GROUP BY 1")
def place_draws(spark, sf):
    """What each step places, declines and rescales."""
    p = B.place(decided(spark, sf), F.lit(0.5))
    return p.groupBy("step").agg(F.count_if("kept").alias("kept"), F.count("reason").alias("declined"), F.count_if("rescaled").alias("rescaled"), F.round(F.sum(F.col("advantage").cast("decimal(28,12)")).cast("double"), 6).alias("mass"))


@query(DECIDED + "SELECT step, count(reason) AS declined, count(*) AS n FROM dec GROUP BY 1 HAVING count(reason) > 2")
def policy_refused_steps(spark, sf):
    """Steps that a cap of two declines refuses."""
    return B.refused_steps(decided(spark, sf), 2)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2 AND l_discount > 0.09""")
def verify_written(spark, sf):
    """Rows that don't read back as they were to be written."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, sf, "lineitem").select(*keys, "l_tax", "l_discount")
    want = li.where("l_linenumber <= 2").select(*keys, F.col("l_tax").alias("x"))
    read = li.withColumn("x", F.when((F.col("l_linenumber") <= 2) & (F.col("l_discount") > 0.09), F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return B.miswritten(read, want, keys, ["x"]).select(*keys)


@query("""SELECT p_size, pow(2, ceil(log2(p_size)))::BIGINT AS slots FROM part GROUP BY 1""")
def scalar_power_of_two(spark, sf):
    """Slots of a tree that holds so many entries."""
    s = table(spark, sf, "part").select("p_size").distinct()
    return s.select("p_size", S.next_power_of_two(F.col("p_size")).alias("slots"))


@query("SELECT lower(substr(md5(url), 1, 1)) AS shard, count(*) AS n, count(*) FILTER (WHERE regexp_matches(token, '^(0|[1-9][0-9]*)$')) AS canonical FROM (SELECT url, regexp_extract(url, '([^/=?#]*)[?#]?[^/?#]*$', 1) AS token FROM pages) GROUP BY 1")
def check_canonical_numbers(spark, sf):
    """Last path parts of urls that are canonical digit strings, by shard."""
    token = F.regexp_extract("url", r"([^/=?#]*)[?#]?[^/?#]*$", 1)
    p = table(spark, sf, "pages").select(F.substring(F.md5("url"), 1, 1).alias("shard"), L.canonical_int(token).alias("ok"))
    return p.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("canonical"))


@query("""WITH a AS (SELECT event_id, event_type, user_id, value FROM events), b AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 100 <> 99)
SELECT a.event_id, concat_ws(',', CASE WHEN b.event_id IS NULL THEN 'missing' END, CASE WHEN b.event_id IS NOT NULL AND a.user_id IS DISTINCT FROM b.user_id THEN 'user_id' END,
 CASE WHEN b.event_id IS NOT NULL AND a.value IS DISTINCT FROM b.value THEN 'value' END) AS fields
FROM a LEFT JOIN b USING (event_id) WHERE b.event_id IS NULL OR a.user_id IS DISTINCT FROM b.user_id OR a.value IS DISTINCT FROM b.value""")
def diff_records(spark, sf):
    """Records of two logs that differ, with the fields that do."""
    a = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    b = a.where("event_id % 100 <> 99").withColumns({"user_id": F.when(F.col("event_id") % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")), "value": F.when(F.col("event_id") % 7 != 0, F.col("value"))})
    return L.differing(a, b, "event_id", ["event_type", "user_id", "value"])


@query("SELECT conv_id, CASE WHEN try_cast(a AS DOUBLE) = try_cast(b AS DOUBLE) THEN 1.0 ELSE 0.0 END AS reward FROM (SELECT conv_id, regexp_extract(max_by(text, turn), '(?:^|[^0-9])(-?[0-9]+)[^0-9]*$', 1) AS a, regexp_extract(min_by(text, turn), '(?:^|[^0-9])(-?[0-9]+)[^0-9]*$', 1) AS b FROM conversations WHERE NOT regexp_matches(text, '[0-9][.,]|####|[.,][0-9]') GROUP BY 1)")
def reward_numbers(spark, sf):
    """Reward of each conversation's last message against its first, by number answer (messages with plain integers)."""
    from embertide.functions import answers as A

    c = table(spark, sf, "conversations").where(~F.col("text").rlike(r"[0-9][.,]|####|[.,][0-9]")).groupBy("conv_id").agg(F.max_by("text", "turn").alias("a"), F.min_by("text", "turn").alias("b"))
    return c.select("conv_id", A.number_reward(F.col("a"), F.col("b")).alias("reward"))


@query()
def tensor_digests(spark, sf):
    """Digest of each vector as a batch tensor, masked places as zero."""
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", X.tensor_digest_udf(F.lit("x"), F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: (x > 0).cast("int"))).alias("digest"))
