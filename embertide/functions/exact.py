"""Functions that need Python's exact integers, rationals or hashes, as Arrow-batched pandas UDFs.

Each is a plain Python function with a UDF beside it; nothing here has an equal built in.
"""

from __future__ import annotations

import decimal
import json
import math
from fractions import Fraction
from hashlib import blake2b

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Domain of the keyed draws made here. Draws of a log made under another domain are recomputed by giving that (`domain`).
DRAW = b"embertide-draws" + bytes(1)
#: Personalisation of the other hash domains (fixed values).
CONTENT = b"rollout-content" + bytes(1)
CHAIN = b"attest" + bytes(10)
TENSORS = b"batch-tensors" + bytes(2)


def keyed_draw(n: int, seed: int, buffer_id: int, counter: int, domain: bytes = DRAW) -> int:
    """A uniform integer below n that depends on its arguments alone, by rejection."""
    if not 0 < n < 1 << 64:
        raise ValueError("n must be in 1 .. 2**64 - 1")
    if n == 1:
        return 0
    fields = (x.to_bytes(8, "big") for x in (seed, buffer_id, counter))
    key = blake2b(b"\xff".join(fields), digest_size=32, person=domain).digest()
    bound, block = (1 << 256) // n * n, 0
    while True:
        value = int.from_bytes(blake2b(key + block.to_bytes(8, "big"), digest_size=32, person=domain).digest(), "big")
        if value < bound:
            return value % n
        block += 1


_RATIONAL = T.StructType([T.StructField("num", T.StringType()), T.StructField("den", T.StringType()), T.StructField("f", T.DoubleType())])


def draw_udf(seed: int, buffer_id: int = 0, domain: bytes = DRAW):
    """Column function (n, counter) -> DECIMAL(20,0)."""

    @F.pandas_udf(T.DecimalType(20, 0))
    def draw(n: pd.Series, counter: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else decimal.Decimal(keyed_draw(int(a), seed, buffer_id, int(c), domain)) for a, c in zip(n, counter, strict=True)])

    return draw


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def content_digest(prompt_id: str, tokens: list[int], reward: float) -> str:
    body = canonical_json({"prompt_id": prompt_id, "tokens": [int(t) for t in tokens], "reward": float(reward).hex()})
    return blake2b(body.encode(), digest_size=32, person=CONTENT).hexdigest()


@F.pandas_udf(T.StringType())
def content_digest_udf(prompt_id: pd.Series, tokens: pd.Series, reward: pd.Series) -> pd.Series:
    return pd.Series([content_digest(p, list(t), r) for p, t, r in zip(prompt_id, tokens, reward, strict=True)])


def record_digest(record: dict) -> str:
    body = canonical_json({k: v for k, v in record.items() if k != "digest"})
    return blake2b(body.encode(), digest_size=32, person=CHAIN).hexdigest()


@F.pandas_udf(T.StringType())
def record_digest_udf(raw: pd.Series) -> pd.Series:
    """Digest of a log line without its own digest; null if the line is no JSON object."""

    def one(line: str) -> str | None:
        try:
            value = json.loads(line)
        except ValueError:
            return None
        return record_digest(value) if isinstance(value, dict) else None

    return raw.map(one)


@F.pandas_udf(T.StringType())
def float_hex(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else float(v).hex())


@F.pandas_udf(T.DoubleType())
def from_hex(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else float.fromhex(v))


def prompt_id_of(tokens: list[int]) -> str:
    return blake2b(",".join(str(int(t)) for t in tokens).encode(), digest_size=8).hexdigest()


@F.pandas_udf(T.StringType())
def prompt_id_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: prompt_id_of(list(t)))


def exact_weight(n: int, leaf: int, least: int, total: int, beta: float) -> Fraction:
    """Quotient of the two doubles (n p / total)**-beta, each base divided once, correctly rounded."""
    return Fraction((n * leaf / total) ** -beta) / Fraction((n * least / total) ** -beta)


def weight_udf(beta: float):
    """Column function (n, leaf, least, total) -> struct num, den, f."""

    @F.pandas_udf(_RATIONAL)
    def weight(n: pd.Series, leaf: pd.Series, least: pd.Series, total: pd.Series) -> pd.DataFrame:
        ws = [exact_weight(*map(int, x), beta) for x in zip(n, leaf, least, total, strict=True)]
        return pd.DataFrame({"num": [str(w.numerator) for w in ws], "den": [str(w.denominator) for w in ws], "f": [float(w) for w in ws]})

    return weight


@F.pandas_udf(_RATIONAL)
def probability_udf(leaf: pd.Series, total: pd.Series) -> pd.DataFrame:
    ps = [Fraction(int(a), int(b)) for a, b in zip(leaf, total, strict=True)]
    return pd.DataFrame({"num": [str(p.numerator) for p in ps], "den": [str(p.denominator) for p in ps], "f": [float(p) for p in ps]})


def effective_size(weights: list[Fraction]) -> Fraction:
    """(sum w)**2 / sum w**2, exact; 0 without weights."""
    squares = sum((w * w for w in weights), Fraction(0))
    return sum(weights, Fraction(0)) ** 2 / squares if squares else Fraction(0)


_CONTEXT = decimal.Context(prec=30, rounding=decimal.ROUND_HALF_EVEN)


def exact_exp(x: float) -> Fraction:
    """exp at 30 digits, half even, of x held to -700 .. 700."""
    return Fraction(_CONTEXT.exp(decimal.Decimal(max(-700.0, min(700.0, x)))))


@F.pandas_udf(T.StringType())
def exact_exp_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: str(_CONTEXT.exp(decimal.Decimal(max(-700.0, min(700.0, v))))))


def weight_within_one_ulp(declared: Fraction, n: int, leaf: int, least: int, total: int, beta: float) -> bool:
    """Whether a weight is the quotient of two powers, each at most one ulp from this machine's."""
    try:
        powers = [(n * x / total) ** -beta for x in (leaf, least)]
    except (ArithmeticError, ValueError):
        return False
    if not all(math.isfinite(x) for x in powers) or powers[1] == 0:
        return False
    near = [(x, math.nextafter(x, math.inf), math.nextafter(x, 0.0)) for x in powers]
    return any(declared == Fraction(a) / Fraction(b) for a in near[0] for b in near[1] if b > 0 and math.isfinite(a))


@F.pandas_udf(T.StringType())
def content_digest_hex_udf(prompt_id: pd.Series, tokens: pd.Series, reward_hex: pd.Series) -> pd.Series:
    """content_digest of a manifest line, whose reward is spelled in hex; null where the line lacks a field or spells it wrong."""

    def one(p, t, r) -> str | None:
        try:
            return content_digest(p, list(t), float.fromhex(r)) if float.fromhex(r).hex() == r else None
        except (TypeError, ValueError, OverflowError):
            return None

    return pd.Series([one(*x) for x in zip(prompt_id, tokens, reward_hex, strict=True)], dtype=object)


def within_one_ulp(a: float, b: float) -> bool:
    return a == b or math.nextafter(a, b) == b


def priority_int(x: float, alpha: float) -> int:
    """floor(x**alpha * 2**52), exact on the double power."""
    return math.floor(Fraction(x**alpha) * (1 << 52)) if x else 0


@F.pandas_udf(T.StringType())
def priority_int_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: str(priority_int(v, 0.6)))


@F.pandas_udf(_RATIONAL)
def counted_ess_udf(nums: pd.Series, dens: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """Effective size of weights, each given with how often it occurs."""
    rows = []
    for ns, ds, cs in zip(nums, dens, counts, strict=True):
        ws = [(Fraction(int(n), int(d)), int(c)) for n, d, c in zip(ns, ds, cs, strict=True)]
        squares = sum((w * w * c for w, c in ws), Fraction(0))
        size = sum((w * c for w, c in ws), Fraction(0)) ** 2 / squares if squares else Fraction(0)
        rows.append((str(size.numerator), str(size.denominator), float(size)))
    return pd.DataFrame(rows, columns=["num", "den", "f"])


def tensor_digest(tensors: list[tuple[str, tuple[int, ...], str, bytes]]) -> str:
    """Digest over tensors in order: name|shape|kind and a line end, then little-endian 64-bit values."""
    h = blake2b(digest_size=32, person=TENSORS)
    for name, shape, kind, data in tensors:
        h.update(f"{name}|{'x'.join(map(str, shape))}|{kind}\n".encode() + data)
    return h.hexdigest()


@F.pandas_udf(T.StringType())
def tensor_digest_udf(name: pd.Series, values: pd.Series, mask: pd.Series) -> pd.Series:
    """tensor_digest of one float row each; places outside the mask count as +0.0."""
    import numpy as np

    def one(n, x, m) -> str:
        kept = np.where(np.asarray(m) != 0, np.asarray(x, "<f8"), 0.0).astype("<f8")
        return tensor_digest([(n, kept.shape, "f64", kept.tobytes())])

    return pd.Series([one(*x) for x in zip(name, values, mask, strict=True)], dtype=object)
