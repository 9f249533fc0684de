"""Decay arithmetic, keyed draws, sampling, policy and transitions against plain Python."""

import json
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertide.functions import answers, decay, exact
from embertide.operators import batches, eventlog, experiments, sampling, scan, state, transitions
from embertide.plans import w3_state, w6_experiments
from embertide.sources import logs
from embertide.streaming.buffer import Buffer


def test_decay_table():
    assert decay.decay_table(4) == (2147483648, 2553802833, 3037000499, 3611622602)
    for h in (1, 2, 7, 24):
        for k, t in enumerate(decay.decay_table(h)):
            assert t**h <= 1 << (k + 31 * h) < (t + 1) ** h


def test_leaf_matches_big_integers(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 1, r.randrange(1 << 32)]), r.randrange(12, 60)) for _ in range(500)] + [(65536, v) for v in range(12, 22)]
    df = spark.createDataFrame(rows, "q long, v long").select("q", "v", decay.leaf(F.col("q"), F.col("v"), 3, 4).alias("leaf"))
    table = decay.decay_table(4)
    for q, v, leaf in df.collect():
        assert int(leaf) == (q * table[v % 4] >> 31) << (v // 4 - 3)


def test_quantize(spark):
    xs = [0.0, 1e-6, 1.0, 1000.0, -1.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(decay.quantize(F.col("x")))
    assert [r[0] for r in df.collect()] == [0, 1, 65536, 65536000, None, None, None]


def test_keyed_draws():
    from hashlib import blake2b

    def plain(n, seed, buffer, counter, domain):
        key = blake2b(b"\xff".join(x.to_bytes(8, "big") for x in (seed, buffer, counter)), digest_size=32, person=domain).digest()
        for block in range(1000):
            x = int.from_bytes(blake2b(key + block.to_bytes(8, "big"), digest_size=32, person=domain).digest(), "big")
            if x < 2**256 - 2**256 % n:
                return x % n

    for domain in (exact.DRAW, b"another domain"):
        for n, seed, buffer, counter in [(1000, 0, 0, c) for c in range(8)] + [(1000, 42, 7, 3), (2**64 - 1, 0, 0, 0), (3, 1, 2, 3)]:
            assert exact.keyed_draw(n, seed, buffer, counter, domain) == plain(n, seed, buffer, counter, domain)
    assert [exact.keyed_draw(1000, 0, 0, c) for c in range(4)] != [exact.keyed_draw(1000, 0, 0, c, b"another domain") for c in range(4)]
    assert exact.keyed_draw(1, 5, 5, 5) == 0


def test_exact_functions():
    assert exact.within_one_ulp(1.0, 1.0 + 2**-52) and not exact.within_one_ulp(1.0, 1.0 + 2**-50)
    assert exact.effective_size([Fraction(1)] * 5) == 5
    assert exact.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'


def test_running_sum_and_ranks(spark, monkeypatch):
    rows = [(i * 3 + 1, (i * 7919) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, v long")
    monkeypatch.setattr(scan, "TOP", 6)  # so sums of blocks are scanned in blocks too
    got = {r.o: int(r.s) for r in scan.running_sum(df, "o", F.col("v"), "s", rows=100).collect()}
    total = 0
    for o, v in rows:
        total += v
        assert got[o] == total
    assert {r.o: r.n for r in scan.ranked(df, "o", "n", rows=300).collect()} == {o: i for i, (o, _) in enumerate(rows)}
    wide = df.withColumn("o", F.col("o") * F.col("o") * 1000).withColumn("k", F.col("v") % 3)  # sparse, uneven orders, by key
    got = {r.o: r.n for r in scan.ranked(wide, "o", "n", rows=200, keys=["k"]).collect()}
    seen = [0, 0, 0]
    for o, v in rows:
        assert got[o * o * 1000] == seen[v % 3]
        seen[v % 3] += 1
    assert scan.ranked(df.limit(0), "o", "n").collect() == []


def test_locate_is_the_inverse_cdf(spark):
    r = random.Random(2)
    leaves = [r.choice([0, 1, 5, 1000]) for _ in range(400)]
    st = spark.createDataFrame(list(enumerate(leaves)), "slot long, leaf long").withColumn("leaf", F.col("leaf").cast("decimal(20,0)"))
    draws = spark.range(sum(leaves)).where("id % 7 = 0").select(F.col("id").alias("k"), F.col("id").cast("decimal(38,0)").alias("draw"))
    edges = [s for s, leaf in enumerate(leaves) for _ in range(leaf)]
    for rows in (40, 10_000):
        got = {r.k: r.slot for r in sampling.locate(st, draws, bands=16, rows=rows).collect()}
        assert got == {k: edges[k] for k in range(0, sum(leaves), 7)}


def naive_policy(rows, p):
    reasons = [None if abs(r["ratio"]) < float("inf") else "drift" for r in rows]
    reasons = ["age" if x is None and p.max_age is not None and r["age"] > p.max_age else x for x, r in zip(reasons, rows)]
    kept = [i for i, x in enumerate(reasons) if x is None]
    order = sorted(kept, key=lambda i: (-abs(rows[i]["ratio"]), i))
    w = {i: Fraction(str(rows[i]["w"])) for i in kept}
    while p.ess_floor is not None and len(order) > 1 and sum(w[i] for i in order) ** 2 < Fraction(p.ess_floor) * len(order) * sum(w[i] ** 2 for i in order):
        reasons[order.pop(0)] = "ess"
    return ["drift" if x is None and p.max_log_ratio is not None and abs(r["ratio"]) > p.max_log_ratio else x for x, r in zip(reasons, rows)]


def test_policy_stages(spark):
    r = random.Random(3)
    policy = batches.Policy(max_age=5, ess_floor=0.75, mass_cap=1.0, max_log_ratio=0.9)
    rows = [
        {"step": s, "draw": k, "ratio": r.choice([float("inf"), r.uniform(-1, 1), 0.5]), "w": round(r.uniform(0.01, 1) ** 3 + 0.001, 6), "age": r.randrange(8), "grp": k % 3}
        for s in range(12) for k in range(r.randrange(1, 20))
    ]
    df = spark.createDataFrame(rows, "step long, draw long, ratio double, w double, age long, grp long")
    got = {(x.step, x.draw): x.reason for x in batches.decide(df, policy).collect()}
    for s in range(12):
        own = [x for x in rows if x["step"] == s]
        assert [got[s, x["draw"]] for x in own] == naive_policy(own, policy)


def test_policy_refuses_too_many_declines(spark):
    df = spark.createDataFrame([(0, k, 0.1 * k, 1.0, k, 0) for k in range(6)], "step long, draw long, ratio double, w double, age long, grp long")
    assert batches.decide(df, batches.Policy(max_age=3, max_declines_per_step=2)).where("reason is not null").count() == 2
    with pytest.raises(Exception, match="3 declines in a step exceed 2"):
        batches.decide(df, batches.Policy(max_age=2, max_declines_per_step=2)).collect()
    told = batches.decide(df, batches.Policy(max_age=2))
    assert [tuple(r) for r in batches.refused_steps(told, 2).collect()] == [(0, 3, 6)] and batches.refused_steps(told, 3).collect() == []
    placed = {r.draw: (r.kept, r.advantage, r.rescaled) for r in batches.place(told.withColumn("scale", F.when(F.col("draw") == 1, 0.5).otherwise(1.0)), F.lit(2.0)).collect()}
    assert placed[1] == (True, 1.0, True) and placed[0] == (True, 2.0, False) and placed[5] == (False, None, False)


def test_nstep_matches_a_queue(spark):
    r = random.Random(4)
    rows = [(e, t, float(r.randrange(10)), r.random() < 0.15) for e in range(4) for t in range(40)]
    df = spark.createDataFrame(rows, "env long, t long, r double, d boolean")
    got = {(x.env, x.t): (x.g, x.steps, x.last, x.done) for x in transitions.nstep_returns(df, "env", "t", F.col("r"), F.col("d"), 3, 0.5).collect()}
    want = {}
    for e in range(4):
        queue = []

        def flush(e=e, queue=queue):
            want[e, queue[0][1]] = (sum(x[2] * 0.5**k for k, x in enumerate(queue)), len(queue), queue[-1][1], queue[-1][3])
            queue.pop(0)

        for row in (x for x in rows if x[0] == e):
            queue.append(row)
            if len(queue) == 3:
                flush()
            while row[3] and queue:
                flush()
    assert got == want


def test_hindsight_over_the_whole_episode(spark):
    rows = [(e, i) for e in range(3) for i in range(e * 100, e * 100 + 5 * e + 1)]
    got = transitions.hindsight(spark.createDataFrame(rows, "e long, i long"), "e", "i", "i", "episode", 4).collect()
    assert sorted((x.i, x.j, x.new_goal) for x in got) == [(i, j, e * 100 + (i * 31 + j * 17 + 7) % (5 * e + 1)) for e, i in rows for j in range(4)]
    assert any(x.new_goal < x.i for x in got)


def test_log_round_trip_and_violations(spark, tmp_path):
    records = [{"op": "decay_config", "format": 4, "half_life": 2}] + [{"op": "insert", "index": i, "new_priority_int": str(2**63 + i)} for i in range(5)]
    lines = logs.chained(records)
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(lines) + "\n")
    log = logs.read_log(spark, str(path))
    assert log.where("op = 'insert'").select(F.max("new_priority_int")).first()[0] == str(2**63 + 4)
    assert logs.log_violations(log).collect() == []
    broken = json.loads(lines[3])
    broken["extra"] = 1
    path.write_text("\n".join([*lines[:3], json.dumps(broken), *lines[4:]]))
    found = {(r.ord, r.problem) for r in logs.log_violations(logs.read_log(spark, str(path))).collect()}
    assert found == {(4, "unknown keys: extra"), (4, "digest")}


def test_snapshot_refuses_a_second_write(spark, tmp_path):
    st = spark.createDataFrame([(1, 2, 3)], "slot long, q long, version long")
    logs.save_snapshot(st, str(tmp_path), "a", {"op_counter": 7})
    back, counters = logs.load_snapshot(spark, str(tmp_path), "a")
    assert back.collect() == st.collect() and counters == {"op_counter": 7}
    with pytest.raises(Exception, match="(?i)exists"):
        logs.save_snapshot(st, str(tmp_path), "a", {})


def test_merge_and_allocation(spark):
    st = spark.createDataFrame([(0, 5, 1), (2, 6, 1)], "slot long, q long, version long")
    ch = spark.createDataFrame([(1, 0, "write", 9, 2), (2, 0, "write", 8, 3), (3, 2, "evict", 0, 0), (4, 7, "write", 1, 3)], "seq long, slot long, op string, q long, version long")
    assert sorted(map(tuple, state.merge(st, ch).collect())) == [(0, 8, 3), (7, 1, 3)]
    members = spark.createDataFrame([("a",), ("b",)], "m string").withColumn("o", F.when(F.col("m") == "a", 1).otherwise(2))
    assert sorted((r.m, r.slot) for r in state.allocate(members, state.free_slots(5, st), "o").collect()) == [("a", 1), ("b", 3)]


def test_every_user_gets_a_slot(spark, tmp_path):
    users = 21_000
    events = spark.range(users).selectExpr("id as event_id", "id as user_id", "timestamp'2024-01-20 00:00:00' + make_interval(0, 0, 0, id % 10) as ts",
                                           "'view' as event_type", "50.0D as value", "'{}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = w3_state.alloc_free_slots(spark, str(tmp_path)).collect()
    held = {r.slot for r in w3_state.state(spark, str(tmp_path)).collect()}
    free = (s for s in range(2 * users) if s not in held)
    assert held and {r.user_id: r.slot for r in got} == dict(zip(range(users), free))


def test_first_difference(spark):
    a = spark.createDataFrame([(i, i, "x") for i in range(9)], "ord long, u long, s string")
    b = a.where("ord < 8").withColumn("s", F.when(F.col("ord") == 5, None).otherwise(F.col("s")))
    assert eventlog.first_difference(a, b, "ord", ["u", "s"]).collect() == [(5, "s")]


def test_answers(spark):
    texts = ["so 1,234.50 it is", "#### 7 or 8", "none", "a -3 b", None, "5 then #### none", "1-2", "#### x #### 4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(answers.number_answer(F.col("t")))
    assert [None if r[0] is None else float(r[0]) for r in df.collect()] == [1234.5, 7.0, None, -3.0, None, 5.0, 2.0, 4.0]
    assert answers.boxed(r"x \boxed{1} y \boxed{\frac{1}{2}} z") == r"\frac{1}{2}" and answers.boxed(r"\boxed{1} \boxed{open") is None
    pairs = spark.createDataFrame([("so 1,000", "#### 1000.0"), ("none", "none"), ("2", "3")], "c string, a string")
    assert [r[0] for r in pairs.select(answers.number_reward(F.col("c"), F.col("a"))).collect()] == [1.0, 0.0, 0.0]


def test_latex_answers(spark):
    same = [(r"\frac{1}{2}", "0.5"), (r"\dfrac12", r"\dfrac12"), (r"-\tfrac{3}{4}", "-3/4"), (r"x=5", "5"), (r"\text{ 12 }", "12"), ("1,234", "1234"), (r"90^{\circ}", "90"), (r"50\%", "50"), (r"\left(1,2\right)", "(1,2)"), ("$7$.", "7")]
    assert all(answers.same_latex(a, b) for a, b in same)
    assert not any(answers.same_latex(a, b) for a, b in [("1", "2"), ("", ""), (None, "1"), (r"\frac{1}{0}", "1"), ("12,34", "1234")])
    assert answers.latex_answer(r"so \boxed{ 3 }") == "3" and answers.latex_answer("#### 4 \n 5") == "4" and answers.latex_answer("6 and 7") == "7" and answers.latex_answer("no") is None
    df = spark.createDataFrame([(r"thus \boxed{\frac{2}{4}}", "0.5"), (None, "1")], "c string, a string")
    assert [r[0] for r in df.select(answers.latex_reward_udf("c", "a")).collect()] == [1.0, 0.0]


def test_boxed_reads_whole_texts(spark, tmp_path):
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choices(["\\boxed{", "{", "}", "}", "a", "\\", "boxed", " "], k=r.randint(0, 14)))
        at, want = text.rfind("\\boxed{"), None
        for i in range(at + 7, len(text) + 1) if at >= 0 else ():
            inner = text[at + 7 : i]
            if text[i : i + 1] == "}" and inner.count("{") == inner.count("}"):
                want = inner
                break
        assert answers.boxed(text) == want, text
    began = time.process_time()
    assert answers.boxed("\\boxed{x}" + "\\boxed{" * 8_000) is None and answers.boxed("\\boxed{" + "{}" * 200_000 + "}") == "{}" * 200_000
    assert time.process_time() - began < 2
    texts = ["one two three four " * 50 + "\\boxed{\\frac{1}{2}} and so on", "no box here at all", "\\boxed{a} b c d \\boxed{e f g h i}", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.boxed for x in w6_experiments.str_boxed(spark, str(tmp_path)).collect()} == {0: "\\frac{1}{2}", 1: None, 2: "e f g h i", 3: None}


def plain_interval(rows, resamples=2000):
    """rows: scores by seed and item."""
    rng, means = np.random.default_rng(0), []
    for _ in range(resamples):
        seeds = rng.integers(0, rows.shape[0], size=rows.shape[0])
        items = rng.integers(0, rows.shape[1], size=rows.shape[1])
        means.append(rows[np.ix_(seeds, items)].mean())
    means.sort()
    return rows.mean(), means[49], means[1950]


@pytest.mark.parametrize("block", [7, 50_000])
def test_bootstrap_is_numpys_over_seeds_and_items(spark, monkeypatch, block):
    monkeypatch.setattr(experiments, "ITEM_BLOCK", block)
    r = np.random.default_rng(5)
    arms = {"a": r.normal(size=(3, 20)), "b": r.normal(1, 1, size=(4, 9))}
    rows = [(arm, s, i * 3, float(x)) for arm, m in arms.items() for (s, i), x in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "arm string, seed long, item long, score double")
    got = {x.arm: (x.mean, x.lo, x.hi) for x in experiments.bootstrap(df, ["arm"], "seed", "item", "score").collect()}
    assert all(got[a] == pytest.approx(plain_interval(m), abs=1e-12) for a, m in arms.items())
    with pytest.raises(Exception, match="same items"):
        experiments.bootstrap(df.where("not (arm = 'a' and seed = 1 and item = 0)"), ["arm"], "seed", "item", "score").collect()
    base = df.where("arm = 'a' and seed < 2").select("seed", "item", (F.col("score") * 0.5).alias("score"))
    (row,) = experiments.paired_bootstrap(df.where("arm = 'a'"), base, ["arm"], "seed", "item", "score").collect()
    half = arms["a"][:2] / 2
    assert (row.mean, row.lo, row.hi) == pytest.approx(plain_interval(half), abs=1e-12) and (row.seeds, row.above) == (2, int((half.mean(1) > 0).sum()))


def test_buffer_lifecycle():
    b = Buffer(decay.Decay(half_life=1, max_age=2, capacity=4))
    assert [x[:2] for x in b.add([1, 2, 3], 0, 0)] == [("insert", 0), ("insert", 1), ("insert", 2)]
    assert [(x[0], x[1], x[4]) for x in b.add([4, 5], 1, 1)] == [("evict", 0, "capacity"), ("insert", 0, None), ("insert", 3, None)]
    assert b.add([9, 9, 9], 0, 2)[0][4] == "would evict newer entries"
    assert [(x[1], x[4]) for x in b.advance(3)] == [(1, "stale"), (2, "stale")]
    with pytest.raises(ValueError):
        b.advance(2)
    assert b.add([1], 0, 3)[0][4] == "expired"
