"""Queries that SQL can't express, against plain Python on the smallest tables."""

import decimal
import json
import math
import os
from bisect import bisect_right
from fractions import Fraction
from hashlib import blake2b

import duckdb
import numpy as np
import pytest

from embertide.functions import exact
from embertide.functions.decay import decay_table
from embertide.plans import w2_sampling, w4_log, w6_experiments, w9_attested

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def rows(sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


def rollouts():
    """event_id -> (prompt_id, version, reward)."""
    return {e: (u, v, x / 100) for e, u, v, x in rows("SELECT event_id, user_id, date_diff('day', DATE '2024-01-01', ts::DATE), value FROM events")}


def test_sample_keyed(spark):
    d, table = w2_sampling.DECAY, decay_table(w2_sampling.DECAY.half_life)
    live = {}
    for slot, (prompt, version, reward) in sorted(rollouts().items()):
        if w2_sampling.NOW - version <= d.max_age:
            q = 0 if reward == 0 else max(1, math.floor(reward * 65536))
            live[slot] = (prompt, version, (q * table[version % 4] >> 31) << (version // 4 - w2_sampling.BASE))
    slots, sums, total = list(live), [], 0
    for s in slots:
        total += live[s][2]
        sums.append(total)
    least = min(x for _, _, x in live.values() if x)
    got = {r.k: r for r in w2_sampling.sample_keyed(spark, SF).collect()}
    assert len(got) == w2_sampling.N_DRAWS
    for k, r in got.items():
        draw = exact.keyed_draw(total, 42, 7, k)
        slot = slots[bisect_right(sums, draw)]
        prompt, version, x = live[slot]
        p, w = Fraction(x, total), exact.exact_weight(len(live), x, least, total, w2_sampling.BETA)
        assert (r.draw, r.slot, r.prompt_id, r.version, r.leaf) == (str(draw), slot, prompt, version, str(x))
        assert (Fraction(int(r.prob_num), int(r.prob_den)), Fraction(int(r.weight_num), int(r.weight_den)), r.weight) == (p, w, float(w))


def test_draws_digests_and_spellings(spark):
    roll = rollouts()
    assert {r.event_id: r.draw for r in w2_sampling.keyed_draw(spark, SF).collect()} == {e: exact.keyed_draw(1000, 0, 0, e) for e in roll}
    want = {}
    for e, (prompt, version, reward) in roll.items():
        body = json.dumps({"prompt_id": str(prompt), "tokens": [e, version], "reward": reward.hex()}, sort_keys=True, separators=(",", ":"))
        want[e] = blake2b(body.encode(), digest_size=32, person=exact.CONTENT).hexdigest()
    assert {r.event_id: r.digest for r in w2_sampling.content_digest(spark, SF).collect()} == want
    assert {r.event_id: (r.hex, r.same) for r in w2_sampling.float_hex(spark, SF).collect()} == {e: (x[2].hex(), True) for e, x in roll.items()}
    values = dict(rows("SELECT event_id, value FROM events"))
    got = {r.event_id: int(r.p) for r in w2_sampling.scalar_priority_int(spark, SF).collect()}
    assert got == {e: math.floor(Fraction((v + 1e-6) ** 0.6) * 2**52) for e, v in values.items()}
    kinds = dict(rows("SELECT event_id, event_type FROM events"))
    plain = lambda e, k: json.dumps({"index": str(e), "op": k}, sort_keys=True, separators=(",", ":")).encode()
    want = {e: blake2b(plain(e, k), digest_size=32, person=exact.CHAIN).hexdigest() for e, k in kinds.items()}
    assert {r.event_id: r.digest for r in w4_log.record_digest(spark, SF).collect()} == want


def test_vectors(spark):
    vectors = dict(rows("SELECT vec_id, embedding FROM embeddings"))
    want = {i: blake2b(",".join(str(math.floor(abs(np.float32(x)) * 1000)) for x in v).encode(), digest_size=8).hexdigest() for i, v in vectors.items()}
    got = {r.vec_id: r.prompt_id for r in w2_sampling.prompt_ids(spark, SF).collect()}
    assert got.keys() == want.keys() and sum(got[i] != want[i] for i in got) <= len(got) // 100  # float products may round apart
    digest = {}
    for i, v in vectors.items():
        kept = np.array([x if x > 0 else 0.0 for x in v], "<f8")
        h = blake2b(f"x|{len(v)}|f64\n".encode(), digest_size=32, person=exact.TENSORS)
        h.update(kept.tobytes())
        digest[i] = h.hexdigest()
    assert {r.vec_id: r.digest for r in w9_attested.tensor_digests(spark, SF).collect()} == digest


def test_exact_exp(spark):
    context = decimal.Context(prec=30, rounding=decimal.ROUND_HALF_EVEN)
    want = sorted(str(context.exp(decimal.Decimal(t - d))) for t, d in rows("SELECT l_tax, l_discount FROM lineitem"))
    assert sorted(r.e for r in w2_sampling.scalar_exact_exp(spark, SF).collect()) == want


def test_intervals(spark):
    def interval(matrix):
        rng, means = np.random.default_rng(0), []
        for _ in range(2000):
            s, i = rng.integers(0, matrix.shape[0], size=matrix.shape[0]), rng.integers(0, matrix.shape[1], size=matrix.shape[1])
            means.append(matrix[np.ix_(s, i)].mean())
        means.sort()
        return matrix.mean(), means[49], means[1950]

    got = {r.arm: (r.mean, r.lo, r.hi) for r in w6_experiments.bootstrap_ci(spark, SF).collect()}
    cells = rows("SELECT (doc_id // 3) % 4 AS arm, doc_id // 3 AS item, list(quality ORDER BY doc_id) FROM labels GROUP BY ALL HAVING count(*) = 3 ORDER BY 2")
    for arm in {a for a, _, _ in cells}:
        matrix = np.array([x for a, _, x in cells if a == arm], float).T
        assert got[arm] == pytest.approx(interval(matrix), abs=1e-9)
    sql = "SELECT l_returnflag, l_linenumber % 3, l_partkey % 20, sum(l_discount::DECIMAL(18,4))::DOUBLE / count(*) FROM lineitem GROUP BY ALL"
    score = {(a, s, i): x for a, s, i, x in rows(sql)}
    for r in w6_experiments.paired_bootstrap(spark, SF).collect():
        diff = np.array([[score[r.arm, s, i] - score["N", s, i] for i in range(20)] for s in range(3)])
        assert (r.mean, r.lo, r.hi) == pytest.approx(interval(diff), abs=1e-9) and r.above == (diff.mean(1) > 0).sum()
