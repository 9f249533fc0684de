"""Prefix scans that don't gather the table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of a scan, about, and block sums that meet in one task.
ROWS, TOP = 100_000, 100_000


Span = tuple[int, int | None, int | None]


def span_of(df: DataFrame, order: str) -> Span:
    """Count, least and greatest order of df: what blocks are cut by. One may serve many scans of the same rows or of some of them."""
    return tuple(df.agg(F.count(F.lit(1)), F.min(order).cast("long"), F.max(order).cast("long")).first())


def blocked(df: DataFrame, order: str, name: str, rows: int = ROWS, span: Span | None = None) -> tuple[DataFrame, int]:
    """df with `name`, the number of an equal range of its order values that holds about `rows` rows, and how many blocks there are.

    The width follows from the span, so a sparse order doesn't make a block of each row.
    """
    n, lo, hi = span or span_of(df, order)
    if not n or n <= rows:
        return df.withColumn(name, F.lit(0).cast("long")), 1
    width = max(1, -(-(hi - lo + 1) * rows // n))
    return df.withColumn(name, F.expr(f"({order} - {lo}L) div {width}L").cast("long")), (hi - lo) // width + 1


def running_sums(df: DataFrame, order: str, sums: Mapping[str, tuple[Column, str]], rows: int = ROWS, keys: Sequence[str] = (),
                 span: Span | None = None) -> DataFrame:
    """df with a column for each of `sums` (name: value and type), the sum of its value over all rows (of the same keys) with a smaller or equal order.

    order is a whole number without ties. Rows are summed inside blocks in parallel; the sums of blocks are scanned by the same
    function while there are more than TOP, so no task sees more than TOP sums or about `rows` rows. All values share the blocks, the
    window and the join: scans one after another would each hold the plan below them twice, and so double it.
    """
    block, upto, before = (f"__{x}_{order}" for x in ("block", "upto", "before"))
    own = {out: f"__value{i}_{order}" for i, out in enumerate(sums)}
    kinds = {out: kind for out, (_, kind) in sums.items()}
    held, blocks = blocked(df.select("*", *(value.cast(kind).alias(own[out]) for out, (value, kind) in sums.items())), order, block, rows, span)
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumns({out: F.sum(own[out]).over(inside).cast(kind) for out, kind in kinds.items()})
    if blocks > 1:
        totals = held.groupBy(*keys, block).agg(*(F.sum(c).cast(kinds[out]).alias(c) for out, c in own.items()))
        if blocks > TOP:
            totals = running_sums(totals, block, {upto + c: (F.col(c), kinds[out]) for out, c in own.items()}, TOP, keys)
        else:
            over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
            totals = totals.withColumns({upto + c: F.sum(c).over(over) for c in own.values()})
        totals = totals.select(*keys, block, *((F.col(upto + c) - F.col(c)).cast(kinds[out]).alias(before + c) for out, c in own.items()))
        held = held.join(F.broadcast(totals) if not keys and blocks <= TOP else totals, [*keys, block])
        held = held.withColumns({out: (F.col(out) + F.col(before + own[out])).cast(kind) for out, kind in kinds.items()})
        held = held.drop(*(before + c for c in own.values()))
    return held.drop(block, *own.values())


def running_sum(df: DataFrame, order: str, value: Column, out: str, rows: int = ROWS, kind: str = "decimal(38,0)", keys: Sequence[str] = (),
                span: Span | None = None) -> DataFrame:
    """df with `out` = sum of value over all rows (of the same keys) with a smaller or equal order, by running_sums."""
    return running_sums(df, order, {out: (value, kind)}, rows, keys, span)


def ranked(df: DataFrame, order: str, out: str, rows: int = ROWS, keys: Sequence[str] = (), span: Span | None = None) -> DataFrame:
    """df with `out` = number of rows (of the same keys) with a smaller order, by the same scan."""
    held = running_sum(df, order, F.lit(1), out, rows, "bigint", keys, span)
    return held.withColumn(out, F.col(out) - 1)
