"""Logs of a real buffer verify; each kind of tampering is found where it was made."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from embertide.functions import exact, staleness
from embertide.functions.decay import Decay
from embertide.operators import replay, verify
from embertide.sources import logs
from embertide.streaming.attested import AttestedBuffer


def a_run(seed=5, versions=14, witness=True):
    """A buffer that overflows, expires, rebases, updates, evicts and quarantines."""
    r = random.Random(seed)
    b = AttestedBuffer(Decay(half_life=1, max_age=3, capacity=8), seed=7, buffer_id=3)
    for v in range(versions):
        for g in range(r.randint(1, 2)):
            b.add_group(f"p{v % 4}", [([v, g, k], r.random(), r.choice([0, r.randrange(1, 1 << 20)]) if k else 65536) for k in range(r.randint(1, 3))], v, r.choice(["a", "b", None]))
        n = r.randint(1, 4)
        b.sample(n, v)
        gone = [k for k in range(n) if r.random() < 0.3]
        if witness:
            b.witness(v, 12, [(2 * k, k) for k in range(n) if k not in gone], gone, "ab" * 32)
        b.telemetry(v, 12, n - len(gone), len(gone), {"log_ratio_mean_abs": 0.25})
        live = sorted(b.buffer.live)
        if v % 3 == 1:
            b.update([live[0], live[-1], live[0]], [5, 1 << 18, 9])
        if v % 5 == 2:
            b.evict(live[:1], "drift")
        if v % 5 == 4:
            b.quarantine(live[-1:], "reward < 0", "asked by the data team")
    return b


def read(spark, tmp_path, lines, name="log.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return logs.read_log(spark, str(path))


def found(spark, tmp_path, b, records=None, manifest=None, only=verify.CHECKS):
    log = read(spark, tmp_path, logs.chained(records if records is not None else b.records))
    lines = None
    if manifest is not None:
        (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, manifest)) + "\n")
        lines = logs.read_manifest(spark, str(tmp_path / "manifest.jsonl"))
    return {(r.ord, r.problem) for r in verify.verify_log(log, lines, only=only).collect()}


def test_a_real_log_verifies(spark, tmp_path):
    b = a_run()
    ops = [x["op"] for x in b.records]
    assert {"rebase", "update", "evict", "batch", "telemetry", "insert", "sample", "advance_version"} <= set(ops)
    assert {"stale", "capacity", "drift", "quarantine"} <= {x.get("reason") for x in b.records}
    assert found(spark, tmp_path, b, manifest=b.manifest) == set()


def test_replay_values_are_the_buffers(spark, tmp_path):
    b = AttestedBuffer(Decay(half_life=2, max_age=5, capacity=16), seed=1)
    r, want = random.Random(2), {}
    for v in range(12):
        b.add_group("p", [([v, k], 1.0, r.randrange(1, 1 << 16)) for k in range(r.randint(1, 4))], v)
        for d in b.sample(3):
            leaves = b.leaves()
            want.setdefault(len(b.records), []).append((d.slot, sum(x for s, x in leaves if s < d.slot), dict(leaves)[d.slot], sum(x for _, x in leaves), len(leaves), min(x for _, x in leaves if x)))
    log = read(spark, tmp_path, b.lines())
    decay, _ = verify.config(log)
    clocked = replay.clock(log)
    state = verify.sample_state(clocked, replay.mutations(clocked, decay))
    got = {}
    for x in state.orderBy("ord", "k").collect():
        got.setdefault(x.ord, []).append((x.slot, int(x.lo), int(x.leaf), int(x.total), x.live_entries, int(x.least)))
    assert got == want


def change(which, nth=0, /, **fields):
    """Set fields of the nth record of an op: a value, or a function of the old one."""

    def do(records):
        at = [i for i, x in enumerate(records) if all(x.get(k) == v for k, v in ({"op": which} if isinstance(which, str) else which).items())][nth]
        x = json.loads(json.dumps(records[at]))
        for k, v in fields.items():
            x[k] = v(x.get(k)) if callable(v) else v
            if x[k] is None:
                del x[k]
        return records[:at] + [x] + records[at + 1 :], at + 1

    return do


def drop(which, nth=0):
    def do(records):
        at = [i for i, x in enumerate(records) if all(x.get(k) == v for k, v in ({"op": which} if isinstance(which, str) else which).items())][nth]
        return records[:at] + records[at + 1 :], None

    return do


def in_draw(**fields):
    return lambda samples: [{**samples[0], **{k: v(samples[0][k]) if callable(v) else v for k, v in fields.items()}}, *samples[1:]]


plus = lambda x: str(int(x) + 1)
TAMPERED = {
    "old value": change("insert", 3, old_priority_int="1"),
    "new value": change("update", 0, new_priority_int=plus),
    "base epoch": change("insert", -1, base_epoch=plus),
    "entry version is newer": change("insert", 0, entry_version="99"),
    "reason unknown": change({"op": "evict", "reason": "drift"}, 0, reason="whim"),
    "stale evict of a fresh entry": change({"op": "evict", "reason": "drift"}, 0, reason="stale"),
    "reason without evict": change("update", 0, reason="drift"),
    "quarantine texts": change({"op": "evict", "reason": "quarantine"}, 0, note=None),
    "evict names another entry": change({"op": "evict", "reason": "stale"}, 0, base_priority_int=plus),
    "evict of an empty slot": drop("insert", 1),
    "expired entry outstays": drop({"op": "evict", "reason": "stale"}, 1),
    "rebase is due": drop("rebase"),
    "rebase total after": change("rebase", 0, root_total_after=plus),
    "rebase epochs": change("rebase", 0, new_base_epoch=plus),
    "old version": change("advance_version", 2, old_version=lambda x: str(int(x) - 1)),
    "capacity evicts were not needed": change({"op": "evict", "reason": "drift"}, 0, reason="capacity"),
    "root total": change("sample", 2, root_total=plus),
    "draw is not in its slot": change("sample", 3, samples=in_draw(leaf_index=lambda s: (s + 1) % 8)),
    "not the keyed draw": change("sample", 3, samples=in_draw(draw_int=lambda d: str(int(d) ^ 1))),
    "probability": change("sample", 1, samples=in_draw(prob_num=plus)),
    "not the formula's weight": change("sample", 4, samples=in_draw(is_weight_num="1", is_weight_den="3")),
    "weight out of range": change("sample", 5, samples=in_draw(is_weight_num="4", is_weight_den="3")),
    "entry version of a draw": change("sample", 4, samples=in_draw(entry_version=plus)),
    "unknown keys of a draw": change("sample", 4, samples=in_draw(extra="1")),
    "digest shape": change("insert", 2, content_digest="zz"),
    "digest off an insert": change("update", 0, content_digest="ab" * 32),
    "some inserts lack a digest": change("insert", 5, content_digest=None, source=None),
    "source shape": change("insert", 2, source="a\u0007b"),
    "witness names another sample": change("batch", 2, sample_op_counter=lambda x: x + 1),
    "witness does not cover its draws": change("batch", 1, declined=lambda x: [*x, 40]),
    "row claims another example": change("batch", 0, replaced=lambda x: [{**x[0], "content_digest": "cd" * 32}, *x[1:]]),
    "row outside the batch": change("batch", 0, batch_rows=1, replaced=lambda x: [{**x[0], "row": 9}, *x[1:]]),
    "tensor digest shape": change("batch", 0, tensor_digest="x"),
    "effective size": change("telemetry", 0, ess_num=plus),
    "staleness": change("telemetry", 1, staleness_sum=plus),
    "telemetry disagrees with its witness": change("telemetry", 1, batch_rows="13"),
    "rows are not the draws": change("telemetry", 1, replaced_rows=plus),
    "telemetry names another sample": change("telemetry", 1, sample_op_counter=lambda x: str(int(x) - 1)),
    "unknown keys: extra": change("telemetry", 1, extra="0x1.0p+0"),
    "unknown operation": change("telemetry", 1, op="telemetri"),
}


#: Tampering that changes what the replay sees after it; each is tried alone, the rest in one log at once.
ALONE = dict.fromkeys(("base epoch", "entry version is newer", "reason unknown", "evict names another entry", "evict of an empty slot", "stale evict of a fresh entry"), "mutations")
ALONE |= dict.fromkeys(("expired entry outstays", "rebase is due", "rebase epochs", "old version", "capacity evicts were not needed"), "protocol")
ALONE |= {"witness names another sample": "content", "digest shape": "content", "unknown operation": "chain", "telemetry names another sample": "telemetry"}


@pytest.mark.parametrize("problem", ALONE)
def test_tampering_is_found(spark, tmp_path, problem):
    b = a_run(versions=7)
    records, at = TAMPERED[problem](b.records)
    got = found(spark, tmp_path, b, records, only=[ALONE[problem]])
    assert problem in {p for _, p in got}
    if at and problem != "rebase epochs":
        assert (at, problem) in got


def test_all_other_tampering_is_found_at_once(spark, tmp_path):
    b = a_run(versions=9)
    records, want = b.records, set()
    for problem, do in TAMPERED.items():
        if problem not in ALONE:
            records, at = do(records)
            want.add((at, problem))
    assert len(want) > 20 and want <= found(spark, tmp_path, b, records)


def test_links_and_digests_are_checked_on_the_file(spark, tmp_path):
    lines = a_run(versions=4).lines()
    swapped = [*lines[:4], lines[5], lines[4], *lines[6:]]
    assert {r.problem for r in verify.verify_log(read(spark, tmp_path, swapped), only=["chain"]).collect()} >= {"link"}
    edited = [*lines[:4], lines[4].replace('"op_counter":"', '"op_counter":"1'), *lines[5:]]
    assert "digest" in {r.problem for r in verify.verify_log(read(spark, tmp_path, edited), only=["chain"]).collect()}


def test_manifest_opens_the_log(spark, tmp_path):
    b = a_run(versions=5)
    line = lambda i, **f: [*b.manifest[:i], {**b.manifest[i], **f}, *b.manifest[i + 1 :]]
    assert {p for _, p in found(spark, tmp_path, b, manifest=b.manifest[:-1], only=["chain"])} == {"manifest and inserts differ in number"}
    assert {p for _, p in found(spark, tmp_path, b, manifest=line(2, tokens=[1]), only=["chain"])} == {"manifest digest does not open"}
    assert {p for _, p in found(spark, tmp_path, b, manifest=line(2, source="zz"), only=["chain"])} == {"manifest source"}
    assert {p for _, p in found(spark, tmp_path, b, manifest=line(2, index=7, entry_version=9), only=["chain"])} == {"manifest line of another insert", "manifest version"}


def test_explain_rows(spark, tmp_path):
    b = a_run(versions=6)
    asked = spark.createDataFrame([(s, r) for s in range(6) for r in range(13)], "step long, row long")
    got = {(x.step, x.row): x for x in verify.explain_rows(read(spark, tmp_path, b.lines()), asked).collect()}
    assert set(got) == {(s, r) for s in range(6) for r in range(12)}
    placed = {(int(x["step"]), p["row"]): p for x in b.records if x["op"] == "batch" for p in x["replaced"]}
    for key, x in got.items():
        if key in placed:
            assert (x.kind, x.draw, x.content_digest) == ("replayed", placed[key]["draw"], placed[key]["content_digest"])
            assert x.stored_at == [i + 1 for i, y in enumerate(b.records) if y.get("content_digest") == x.content_digest and y["op"] == "insert"]
        else:
            assert x.kind == "fresh" and x.draw is None


def test_domain_of_another_writer(spark, tmp_path):
    b = AttestedBuffer(Decay(half_life=2, max_age=5, capacity=16), domain=b"another writer")
    b.add_group("p", [([1], 1.0, 65536), ([2], 1.0, 9999)], 0)
    b.sample(5)
    log = read(spark, tmp_path, b.lines())
    assert {r.problem for r in verify.verify_log(log, only=["samples"]).collect()} == {"not the keyed draw"}
    assert verify.verify_log(log, domain=b"another writer", only=["samples"]).collect() == []


def test_writer_refuses(spark):
    b = AttestedBuffer(Decay(half_life=1, max_age=2, capacity=4))
    with pytest.raises(ValueError, match="nothing"):
        b.sample(1)
    b.add_group("p", [([1], 1.0, 65536), ([2], 1.0, 9999)], 0)
    n = len(b.records)
    for bad in (lambda: b.add_group("p", [], 0), lambda: b.update([0, 3], [1, 1]), lambda: b.evict([0], "stale"), lambda: b.quarantine([0], "x", " "), lambda: b.witness(0, 4, [], [], "a")):
        with pytest.raises(ValueError):
            bad()
    assert len(b.records) == n
    b.sample(2)
    with pytest.raises(ValueError):
        b.witness(0, 4, [(0, 0), (0, 1)], [], "ab" * 32)
    b.witness(0, 4, [(0, 0)], [1], "ab" * 32)
    with pytest.raises(ValueError):
        b.telemetry(0, 4, 2, 0)
    b.telemetry(0, 4, 1, 1)
    with pytest.raises(ValueError):
        b.witness(0, 4, [(0, 0)], [1], "ab" * 32)
    assert exact.effective_size([]) == 0


def a_decided_run(seed=3, **policy):
    """Steps whose draws a declared policy keeps, declines or rescales."""
    r = random.Random(seed)
    b = AttestedBuffer(Decay(half_life=2, max_age=6, capacity=16), seed=9)
    declared = staleness.spelled(**policy)
    for v in range(5):
        b.add_group("p", [([v, k], 1.0, 1 << r.randrange(12, 22)) for k in range(4)], v)
        draws = b.sample(6, v)
        ratios, rows = [r.choice([0.1, 1.1, 1.1, 1.1, 1.5, float("inf"), r.uniform(-1, 2)]) for _ in draws], r.sample(range(12), 6)
        told = staleness.decide(staleness.read_policy(json.dumps(declared)), ratios, [d.weight for d in draws], [v - d.version for d in draws], [x // 4 for x in rows])
        spelled = [{"draw": k, "row": x, "group": x // 4, "reason": why, "scale_num": str(s.numerator), "scale_den": str(s.denominator)} for k, (x, (why, s)) in enumerate(zip(rows, told))]
        kept = sum(why is None for why, _ in told)
        b.telemetry(v, 12, kept, 6 - kept, log_ratios=[x.hex() if abs(x) < 9 else "inf" for x in ratios], policy=declared, decisions=spelled)
    return b


def test_declared_decisions_are_replayed(spark, tmp_path):
    b = a_decided_run(seed=6, max_age=1, ess_floor=0.8, mass_cap=0.25, max_log_ratio=1.2, group_size=4)
    reasons = {d["reason"] for x in b.records if x["op"] == "telemetry" for d in x["decisions"]}
    assert reasons == {None, "drift", "age", "ess"} and any(d["scale_den"] != "1" for x in b.records if x["op"] == "telemetry" for d in x["decisions"])
    assert found(spark, tmp_path, b, only=["chain", "telemetry"]) == set()
    at = [i for i, x in enumerate(b.records) if x["op"] == "telemetry"]
    bad = {
        at[0]: ("decisions", lambda d: [{**d[0], "reason": "age" if d[0]["reason"] is None else None, "scale_num": "1", "scale_den": "1"}, *d[1:]], "decisions are not the policy's"),
        at[1]: ("decisions", lambda d: [{**d[0], "group": d[0]["group"] + 1}, *d[1:]], "decision rows"),
        at[2]: ("decisions", lambda d: d[:-1], "decisions are not the draws"),
        at[3]: ("policy", lambda p: {**p, "max_age": 99}, "policy changes"),
        at[4]: ("decisions", lambda d: None, "policy without decisions"),
    }
    records = [x if i not in bad else {k: v for k, v in {**x, bad[i][0]: bad[i][1](x[bad[i][0]])}.items() if v is not None} for i, x in enumerate(b.records)]
    assert {(i + 1, p) for i, (_, _, p) in bad.items()} <= found(spark, tmp_path, b, records, only=["telemetry"])


def test_exact_policy_is_the_window_form(spark):
    from embertide.operators import batches

    r, rows = random.Random(6), []
    for step in range(30):
        for k in range(r.randint(1, 9)):
            rows.append((step, k, r.choice([0.25, -0.5, 1.5, float("inf")]), 1 / 2 ** r.randint(0, 5), r.randrange(6), k % 2))
    df = spark.createDataFrame(rows, "step long, draw long, ratio double, w double, age long, grp long")
    limits = {"max_age": 3, "ess_floor": 0.75, "mass_cap": 0.125, "max_log_ratio": 1.0}
    got = {(x.step, x.draw): (x.reason, x.scale) for x in batches.decide(df, batches.Policy(**limits)).collect()}
    policy = staleness.read_policy(json.dumps(staleness.spelled(**limits)))
    for step in range(30):
        own = [x for x in rows if x[0] == step]
        want = staleness.decide(policy, [x[2] for x in own], [Fraction(x[3]) for x in own], [x[4] for x in own], [x[5] for x in own])
        for x, (reason, scale) in zip(own, want):
            assert got[step, x[1]] == (reason, pytest.approx(float(scale), rel=1e-9))


def test_policies_are_read_strictly():
    fine = staleness.spelled(max_age=2, mass_cap=0.0)
    assert staleness.read_policy(json.dumps(fine))["mass_cap"] == 0
    for bad in ({**fine, "extra": 1}, {**fine, "ess_floor": "0x1p+1"}, {**fine, "max_age": True}, {**fine, "group_size": 0}, {**fine, "mass_cap": "0.5"}, staleness.spelled()):
        with pytest.raises(ValueError):
            staleness.read_policy(json.dumps(bad))
