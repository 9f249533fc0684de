"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import materialize

#: Rows in a block, the unit that is scheduled.
BLOCK_ROWS = 64
#: Rows that meet in one sort; a source is cut into as many buckets as it needs.
BUCKET_ROWS = 4096
#: Weights are rounded to this many parts, or four for each source if that is more.
PARTS = 1000
#: Sources at most: they are named by a weight table, which the driver holds.
MAX_SOURCES = 2000
#: Rows of the schedule broadcast at most (about 60 bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 200_000
#: Without given weights, a source weighs its row count to this power.
TEMPERATURE = 0.7


def to_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole parts in proportion to weights by largest remainder, at least one each."""
    total = sum(Fraction(w) for w in weights.values())
    parts = max(PARTS, 4 * len(weights))
    exact = {s: Fraction(w) * parts / total for s, w in weights.items()}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    spare = parts - sum(whole.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, spare)]:
        whole[s] += 1
    return whole


def pfair_period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(parts) slots, by earliest deadline first.

    The k-th block of a source with p of D parts may not run before slot floor(k D / p) and
    must run before slot ceil((k + 1) D / p). At any time each source is then
    within one block of its share.
    """
    period = sum(parts.values())
    slots: dict[str, list[int]] = {s: [] for s in parts}
    arrivals: list[list[tuple[int, str]]] = [[] for _ in range(period)]
    for s, p in parts.items():
        for k in range(p):
            arrivals[k * period // p].append((-(-(k + 1) * period // p), s))
    waiting: list[tuple[int, str]] = []
    for now in range(period):
        for job in arrivals[now]:
            heapq.heappush(waiting, job)
        deadline, s = heapq.heappop(waiting)
        assert now < deadline
        slots[s].append(now)
    return slots


def plan_phases(blocks: Mapping[str, int], parts: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """(source, phase, first block, end block, parts, period, first slot) and (source, phase, r, slot in period).

    A phase ends when a source has run out; the others go on with their parts.
    """
    left, used = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    phases, offsets, start = [], [], 0
    for phase in range(len(left)):
        if not left:
            break
        now = {s: parts[s] for s in sorted(left)}
        period, slots = sum(now.values()), pfair_period(now)
        length = min((n - 1) // now[s] * period + slots[s][(n - 1) % now[s]] + 1 for s, n in left.items())
        full, rest = divmod(length, period)
        for s in now:
            done = full * now[s] + sum(x < rest for x in slots[s])
            if done:
                phases.append((s, phase, used[s], used[s] + done, now[s], period, start))
                offsets += [(s, phase, r, x) for r, x in enumerate(slots[s][: min(now[s], done)])]
            used[s] += done
            left[s] -= done
        left = {s: n for s, n in left.items() if n}
        start += length
    return phases, offsets


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: doc_id, source, block (of its source), slot (of the block in the mix), pos (in the block).

    Reading blocks by slot gives the mix: until a source runs out, every prefix holds each source
    within one block of its weight; then the remaining sources share in proportion.
    No row is dropped or repeated. Weights must name every source; without
    them a source weighs its row count to the power TEMPERATURE. Null source is a source of
    its own (named null in a weight table by the empty string); rows of a source are
    in order of a hash of seed and doc_id, ties by doc_id; repeated rows each count and stand together. Rows without doc_id are
    dealt by their place in the input. Sources of equal weight and deadline go in order of name. A weight of 0 counts as the least
    part, one of PARTS. An empty table gives an empty result. Other columns are ignored, texts are not read.

    A source is cut by hash into buckets of about BUCKET_ROWS rows, so a hot source sorts in
    many tasks; only bucket sizes are summed along a source. The driver holds the
    weight table and one period for each phase, whatever the number of rows; the schedule is broadcast up to BROADCAST_ROWS.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("src"))
    sizes = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).take(MAX_SOURCES + 1)}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: map them to the names of a weight table first")
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in sizes.items()}
    if missing := set(sizes) - set(weights):
        raise ValueError(f"sources without a weight: {sorted(missing)[:5]}")
    parts = to_parts({s: weights[s] for s in sizes}) if sizes else {}
    phases, offsets = plan_phases({s: -(-n // block_rows) for s, n in sizes.items()}, parts)

    cut = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in sizes.items()], "src string, buckets long")
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", spread)).join(F.broadcast(cut), "src")
    rows = rows.withColumn("bucket", F.expr("shiftright(shiftrightunsigned(h, 33) * buckets, 31)")).drop("buckets")
    rows = materialize(rows, "dealt")  # as the place of a row in the input may differ in another scan
    tally = rows.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    tally = tally.selectExpr("src", "bucket", "sum(n) over (partition by src order by bucket) - n as before")
    rows = rows.withColumn("rn", F.expr("row_number() over (partition by src, bucket order by h, doc_id)"))
    ranked = rows.join(tally, ["src", "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    ranked = ranked.withColumns({
        "block": F.expr(f"rank div {block_rows}"), "pos": (F.col("rank") % block_rows).cast("long")
    })
    phase = spark.createDataFrame(phases, "src string, phase int, lo long, hi long, parts long, period long, start long")
    place = spark.createDataFrame(offsets, "src string, phase int, r long, at long")
    if len(phases) + len(offsets) <= BROADCAST_ROWS:
        phase, place = F.broadcast(phase), F.broadcast(place)
    ranked = ranked.join(phase, "src").where("block >= lo and block < hi")
    ranked = ranked.withColumn("r", F.expr("(block - lo) % parts")).join(place, ["src", "phase", "r"])
    slot = F.expr("start + (block - lo) div parts * period + at")
    return ranked.select("doc_id", "source", "block", slot.alias("slot"), "pos")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
