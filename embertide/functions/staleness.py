"""The staleness policy over exact rationals, for replaying what a log declares (operators.batches has it as windows over many steps)."""

from __future__ import annotations

import json
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions.exact import exact_exp

#: Fields of a declared policy; the middle three are spelled in hex.
FIELDS = ("max_age", "ess_floor", "mass_cap", "max_log_ratio", "max_declines_per_step", "group_size")
_REAL = ("ess_floor", "mass_cap", "max_log_ratio")


def spelled(**policy: float | None) -> dict:
    """A policy as a log declares it."""
    return {f: None if (x := policy.get(f)) is None else float(x).hex() if f in _REAL else int(x) for f in FIELDS}


def read_policy(text: str) -> dict:
    """The numbers of a declared policy; all fields must be there, floats in their canonical spelling, and one stage in use."""
    declared = json.loads(text)
    if not isinstance(declared, dict) or set(declared) != set(FIELDS):
        raise ValueError("a policy has exactly its fields")
    out = {}
    for f, x in declared.items():
        if x is not None and f in _REAL:
            value = float.fromhex(x)
            low = 0 if f == "mass_cap" else math.ulp(0.0)
            if value.hex() != x or not low <= value < math.inf or f == "ess_floor" and value > 1:
                raise ValueError(f"{f} is out of range")
            x = value
        elif x is not None and (type(x) is not int or x < (1 if f == "group_size" else 0)):
            raise ValueError(f"{f} is a whole number")
        out[f] = x
    if all(out[f] is None for f in FIELDS[:4]):
        raise ValueError("a policy has a stage in use")
    return out


def decide(policy: dict, ratios: list[float], weights: list[Fraction], ages: list[int], groups: list[int]) -> list[tuple[str | None, Fraction]]:
    """(reason, scale) of each draw: not finite, too old, victims of the effective size floor, group mass scaled to its cap, ratio too far."""
    told: dict[int, str] = {k: "drift" for k, r in enumerate(ratios) if not math.isfinite(r)}
    left = lambda: [k for k in range(len(ratios)) if k not in told]
    if policy["max_age"] is not None:
        told |= {k: "age" for k in left() if ages[k] > policy["max_age"]}
    if policy["ess_floor"] is not None:
        floor, kept = Fraction(policy["ess_floor"]), sorted(left(), key=lambda k: (abs(ratios[k]), -k))
        one, two = sum((weights[k] for k in kept), Fraction(0)), sum((weights[k] ** 2 for k in kept), Fraction(0))
        while len(kept) > 1 and one**2 < floor * len(kept) * two:
            k = kept.pop()
            told[k], one, two = "ess", one - weights[k], two - weights[k] ** 2
    scale = dict.fromkeys(range(len(ratios)), Fraction(1))
    if policy["mass_cap"] is not None:
        for g in {groups[k] for k in left()}:
            own = [k for k in left() if groups[k] == g]
            mass, cap = sum((weights[k] * exact_exp(ratios[k]) for k in own), Fraction(0)), (1 + Fraction(policy["mass_cap"])) * len(own)
            scale |= dict.fromkeys(own, cap / mass) if mass > cap else {}
    if policy["max_log_ratio"] is not None:
        far = {k: "drift" for k in left() if abs(ratios[k]) > policy["max_log_ratio"]}
        told, scale = told | far, scale | dict.fromkeys(far, Fraction(1))
    return [(told.get(k), scale[k]) for k in range(len(ratios))]


def decision_problem(policy: str, ratios: list[str], weights: list[tuple[str, str]], ages: list[int], declared: list[dict]) -> str | None:
    """What is wrong with the decisions of a record, if anything."""
    try:
        p, xs = read_policy(policy), [float.fromhex(x) for x in ratios]
        if [int(d["draw"]) for d in declared] != list(range(len(ages))) or len(xs) != len(ages):
            return "decisions are not the draws"
        rows, groups = [int(d["row"]) for d in declared], [int(d["group"]) for d in declared]
        scales = [Fraction(int(d["scale_num"]), int(d["scale_den"])) for d in declared]
        if any((s.numerator, s.denominator) != (int(d["scale_num"]), int(d["scale_den"])) for s, d in zip(scales, declared, strict=True)):
            return "decision scale is not reduced"
        if len(set(rows)) < len(rows) or p["group_size"] and any(g != r // p["group_size"] for r, g in zip(rows, groups, strict=True)):
            return "decision rows"
        want = decide(p, xs, [Fraction(int(n), int(d)) for n, d in weights], ages, groups)
    except (ValueError, TypeError, KeyError, ZeroDivisionError):
        return "malformed decisions"
    if p["max_declines_per_step"] is not None and sum(r is not None for r, _ in want) > p["max_declines_per_step"]:
        return "more declines than the policy lets pass"
    return None if want == [(d["reason"], s) for d, s in zip(declared, scales, strict=True)] else "decisions are not the policy's"


@F.pandas_udf(T.StringType())
def decision_problem_udf(policy: pd.Series, ratios: pd.Series, nums: pd.Series, dens: pd.Series, ages: pd.Series, declared: pd.Series) -> pd.Series:
    def one(p, xs, ns, ds, own, told) -> str | None:
        if p is None or told is None or xs is None:
            return None
        return decision_problem(p, list(xs), list(zip(ns, ds, strict=True)), [int(a) for a in own], json.loads(told))

    return pd.Series([one(*x) for x in zip(policy, ratios, nums, dens, ages, declared, strict=True)], dtype=object)
