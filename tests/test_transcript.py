"""Transcripts and commands on the log of a real buffer, against a walk over its records."""

import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from embertide import cli
from embertide.operators.transcript import Transcript
from embertide.sources import logs
from tests.test_verify import a_run


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    b = a_run(versions=8)
    path = tmp_path_factory.mktemp("log") / "log.jsonl"
    path.write_text("\n".join(b.lines()) + "\n")
    return b, str(path), Transcript(logs.read_log(spark, str(path)))


def walk(records):
    """Examples with their draws, inserts and rows, record by record."""
    slots, seen, windows, last = {}, {}, [{}], None
    for ord_, x in enumerate(records, 1):
        if x["op"] == "advance_version":
            windows.append({})
        elif x["op"] == "insert":
            e = seen.setdefault(x["content_digest"], {"inserts": [], "draws": [], "rows": [], "gone": 0, "source": x.get("source"), "quarantined": []})
            e["inserts"].append([ord_, x["index"], int(x["entry_version"]), None])
            slots[x["index"]] = x["content_digest"]
        elif x["op"] == "evict":
            e = seen[slots.pop(x["index"])]
            next(i for i in e["inserts"] if i[1] == x["index"] and i[3] is None)[3] = ord_
            if x["reason"] == "quarantine":
                e["quarantined"].append(ord_)
        elif x["op"] == "sample":
            last = []
            for s in x["samples"]:
                e = seen[slots[s["leaf_index"]]]
                e["draws"].append((ord_, Fraction(int(s["is_weight_num"]), int(s["is_weight_den"]))))
                last.append(e)
                source = e["source"] or "(none)"
                windows[-1][source] = windows[-1].get(source, 0) + 1
        elif x["op"] == "batch":
            for p in x["replaced"]:
                last[p["draw"]]["rows"].append((int(x["step"]), p["row"], p["draw"]))
            for k in x["declined"]:
                last[k]["gone"] += 1
    return seen, windows


def test_exposure_mixture_and_windows(told):
    b, _, t = told
    seen, windows = walk(b.records)
    got = {r.content_digest: r for r in t.exposure().collect()}
    assert got.keys() == seen.keys()
    for d, e in seen.items():
        r, ords = got[d], [o for o, _ in e["draws"]]
        assert (r.times, r.first_ord, r.last_ord, r.source) == (len(ords), min(ords, default=None), max(ords, default=None), e["source"])
        assert (Fraction(int(r.weight_num), int(r.weight_den)) if r.times else None) == (sum(w for _, w in e["draws"]) if ords else None)
        assert [list(x) for x in r.inserts] == e["inserts"]
    drawn = {}
    for w in windows:
        for s, n in w.items():
            drawn[s] = drawn.get(s, 0) + n
    mix = {r.source: (r.inserted, r.sampled) for r in t.mixture().collect()}
    assert {s: n for s, (_, n) in mix.items() if n} == drawn and sum(i for i, _ in mix.values()) == sum(len(e["inserts"]) for e in seen.values())
    assert [r.by_source or {} for r in t.windows().orderBy("window").collect()] == windows


def test_radius(spark, told):
    b, _, t = told
    seen, _ = walk(b.records)
    asked = spark.createDataFrame([(d,) for d in [*seen, "ab" * 32]], "content_digest string")
    got = {r.content_digest: r for r in t.radius(asked).collect()}
    assert not got["ab" * 32].found
    for d, e in seen.items():
        r = got[d]
        assert (r.inserts, r.times, r.unwitnessed, r.declined) == (len(e["inserts"]), len(e["draws"]), 0, e["gone"])
        assert [tuple(x) for x in r.rows or []] == sorted(e["rows"]) and (r.quarantined or []) == e["quarantined"]


def test_commands(spark, told, tmp_path, capsys):
    b, path, _ = told
    assert cli.main(["transcript", path, "--quota", "a=100000", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["quotas"][0]["ok"]
    assert cli.main(["transcript", path, "--quota", "a=0"], spark) == 2 and "EXCEEDED" in capsys.readouterr().out
    assert cli.main(["explain", path, "3", "1"], spark) == 0 and '"kind": "fresh"' in capsys.readouterr().out
    assert cli.main(["explain", path, "99", "1"], spark) == 1
    other = tmp_path / "other.jsonl"
    other.write_text("\n".join(logs.chained([*b.records[:5], {**b.records[5], "op_counter": "999"}, *b.records[6:]])) + "\n")
    assert cli.main(["diff", path, path], spark) == 0 and cli.main(["diff", path, str(other)], spark) == 3
    assert "record 6: op_counter" in capsys.readouterr().out
    assert cli.main(["transcript", path, "--quota", "a=x"], spark) == 1


def test_quotas_are_parsed():
    assert cli.parse_quotas(["a=3", "b=0"]) == {"a": 3, "b": 0}
    for bad in (["a"], ["=3"], ["a=-1"], ["a=1", "a=2"], ["a=²"]):
        with pytest.raises(ValueError):
            cli.parse_quotas(bad)
