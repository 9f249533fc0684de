"""Fixed-point age decay as Column arithmetic on exact integers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the declared arithmetic: priority bits, fraction bits, table bits.
PRIORITY_BITS, FRACTION_BITS, TABLE_BITS = 32, 16, 31


def integer_root(n: int, degree: int) -> int:
    """floor(n ** (1 / degree)) by Newton steps from above."""
    x = 1 << (n.bit_length() + degree - 1) // degree
    while True:
        y = ((degree - 1) * x + n // x ** (degree - 1)) // degree
        if y >= x:
            return x
        x = y


@lru_cache(maxsize=64)
def decay_table(half_life: int, bits: int = TABLE_BITS) -> tuple[int, ...]:
    """T[k] = floor(2 ** (k / half_life) * 2 ** bits)."""
    return tuple(integer_root(1 << (k + bits * half_life), half_life) for k in range(half_life))


@dataclass(frozen=True)
class Decay:
    """Parameters of a buffer: half life and greatest policy age in versions, capacity in entries."""

    half_life: int = 4
    max_age: int = 16
    capacity: int = 4096
    slack: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.half_life <= 1024 or self.max_age < 0 or self.capacity < 1 or self.slack < 0:
            raise ValueError("half_life in 1..1024, max_age and slack from 0, capacity from 1")
        if self.leaf_bits > 64 or self.leaf_bits + (self.capacity - 1).bit_length() > 64:
            raise ValueError("leaves or their total can exceed 64 bits")

    @property
    def max_shift(self) -> int:
        return -(-self.max_age // self.half_life) + self.slack

    @property
    def leaf_bits(self) -> int:
        return PRIORITY_BITS + 1 + self.max_shift

    def base_epoch(self, version: int) -> int:
        return max(0, version - self.max_age) // self.half_life

    def rebase_due(self, version: int, base: int) -> bool:
        return version // self.half_life - base > self.max_shift


def quantize(x: Column) -> Column:
    """0 for 0, else floor(x * 2**16), at least 1; null when negative, not finite or out of range."""
    q = F.when(x == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(x * F.lit(float(1 << FRACTION_BITS))))).cast("long")
    return F.when((x >= 0) & (x < float(1 << (PRIORITY_BITS - FRACTION_BITS))), q)


def leaf(q: Column, version: Column, base: int | Column, half_life: int) -> Column:
    """(q * T[version mod h] >> 31) << (version div h - base), exact, as DECIMAL(20,0); null for a version of an epoch before base."""
    table = F.array(*(F.lit(t).cast("long") for t in decay_table(half_life)))
    t = F.get(table, F.pmod(version, F.lit(half_life)).cast("int"))
    scaled = F.shiftright(F.shiftright(q, 16) * t + F.shiftright(q.bitwiseAND(65535) * t, 16), TABLE_BITS - 16)
    shift = F.floor(version / half_life) - base
    powers = F.array(*(F.lit(1 << k).cast("decimal(20,0)") for k in range(63)))
    return (scaled.cast("decimal(20,0)") * F.get(powers, shift.cast("int"))).cast("decimal(20,0)")


def expired(version: Column, now: int | Column, max_age: int) -> Column:
    """Whether an entry is strictly older than the greatest policy age."""
    return (F.lit(now) if isinstance(now, int) else now) - version > max_age


def rebased(value: Column, epochs: int) -> Column:
    """value / 2**epochs, exact; null if bits would be lost."""
    step = F.lit(1 << epochs).cast("decimal(20,0)")
    return F.when(value % step == 0, (value / step).cast("decimal(20,0)"))
