"""Benchmark decontamination by template canonicalisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import materialize, spread, stay, text_or_empty

#: Words in a template window.
WINDOW = 8
#: A window with fewer words that are no placeholders (a shorter item: with any placeholder) meets only its exact values.
PLAIN_WORDS = 4
#: A document is contaminated by an item when it holds this share of the item's windows, or so many.
SHARE, MANY = 0.5, 6
#: Benchmark windows broadcast at most (16 bytes each); beyond that the join shuffles.
BROADCAST_WINDOWS = 2_000_000
#: Documents that meet an item broadcast at most, with the places asked of them (about 100 bytes each).
BROADCAST_ROWS = 200_000

# Marks of typed placeholders: the value stays behind its mark, for the consistency check.
NUM, NAME, UNIT = "\x01", "\x02", "\x03"
#: Units that make a placeholder when they follow a number.
UNITS = (
    "km|cm|mm|nm|kg|mg|ml|hz|khz|mhz|ghz|kb|mb|gb|tb|kwh|kw|mph|kph|km/h|m/s|"
    "meters?|metres?|miles?|feet|foot|inch(?:es)?|yards?|grams?|pounds?|ounces?|tons?|liters?|litres?|gallons?|"
    "seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|"
    "m|g|l|s|h|w|v|a|c|f|k"
)


def canonical_words(text: Column) -> Column:
    """Lower-case words without punctuation; numbers, units after numbers and names carry a mark.

    A name is a capitalised word that follows a word or comma and one space (so no sentence opens with it).
    """
    for mark in (NUM, NAME, UNIT):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    named = F.regexp_replace(text, r"(\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+)", NAME + "$1")
    joined = F.regexp_replace(named, r"(?<=\d)[.,:/](?=\d)", "")
    marked = F.regexp_replace(joined, r"(?<![\p{L}\p{N}])\d+", NUM + "$0")
    marked = F.regexp_replace(marked, rf"(?i)({NUM}\d+)\s?({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    marked = F.when(text.rlike(r"\d"), marked).otherwise(named)
    return F.array_remove(F.split(F.lower(marked), r"[^\p{L}\p{N}\x01-\x03]+"), "")


#: Low bits of a hash that count plain words.
_COUNT = 4


def _shapes(words: str) -> Column:
    """Hash of each word's template, its low bits 1 for a plain word and 0 for a placeholder, which hashes as its type alone."""
    low = (1 << _COUNT) - 1
    return F.expr(f"transform({words}, w -> if(w < '\x04', xxhash64(substring(w, 1, 1)) & ~{low}L, xxhash64(w) & ~{low}L | 1L))")


def _windows(shapes: str, words: str, n: int) -> str:
    """SQL for the hashes of windows of n words by start: of their template, or of the words with their values if few are plain.

    Equal templates have equally many plain words, so both sides choose alike. Windows of WINDOW words double up from pairs,
    and their low bits add up.
    """
    low = (1 << _COUNT) - 1
    if n != WINDOW:
        plain = f"size(filter(slice({shapes}, i + 1, {n}), s -> (s & 1L) = 1L)) >= {min(PLAIN_WORDS, n)}"
        own = f"if({plain}, xxhash64({n}, slice({shapes}, i + 1, {n})), xxhash64({n}, 'values', slice({words}, i + 1, {n})))"
        return f"if(size({shapes}) < {n}, array(), transform(sequence(0, size({shapes}) - {n}), i -> {own}))"
    out, k = shapes, 1
    while k < WINDOW:
        both = f"xxhash64(a, b) & ~{low}L | ((a & {low}L) + (b & {low}L))"
        out = f"element_at(transform(array({out}), v{k} -> zip_with(v{k}, slice(v{k}, {k + 1}, size(v{k})), (a, b) -> {both})), 1)"
        k *= 2
    out = f"slice({out}, 1, greatest(size({shapes}) - {n - 1}, 0))"
    return f"transform({out}, (h, i) -> if((h & {low}L) < {PLAIN_WORDS}, xxhash64('values', slice({words}, i + 1, {n})), h))"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per (doc_id, item_id) that leaks: windows (distinct item windows met), n_item_windows.

    Both texts become templates (canonical_words); windows of WINDOW template words meet by
    hash, an item of fewer words by its whole template. Matches of one document and item on one diagonal are
    an alignment; there the values behind placeholders must follow one mapping of the item's
    values, else the alignment doesn't count. Exact copies map each value to itself.
    A window with fewer than PLAIN_WORDS plain words (items of fewer words: with a placeholder) meets by its
    words and values, so only an exact copy of it counts. An item leaks by its share of all windows or,
    as values may be new, by its share of those that meet by template.

    Null or empty texts have no windows and meet nothing; rows without doc_id or item_id are
    ignored. Rows that repeat a doc_id are one document that holds what any of them holds, each aligned within its own text;
    equal ones count once. Rows that repeat an item_id with different texts are one item of the windows of each. Extra columns are
    ignored. An empty table on either side gives an empty result. A very long text is read whole, in its row. The
    benchmark is the fixed query set: its windows are broadcast up to BROADCAST_WINDOWS, else joined by shuffle.
    Of a document that meets, only the values behind placeholders of an alignment travel, one row each.
    """
    items = benchmark.where("item_id is not null").select("item_id", F.xxhash64(text_or_empty()).alias("iid"), canonical_words(text_or_empty()).alias("iw"))
    items = materialize(items.where(F.size("iw") > 0).dropDuplicates(["item_id", "iid"]), "items")
    short = [r[0] for r in items.select(F.size("iw")).where(F.size("iw") < WINDOW).distinct().collect()]
    sizes = sorted({WINDOW, *short})  # at most WINDOW of them
    own = F.least(F.size("iw"), F.lit(WINDOW))
    listed = items.withColumn("own", own).withColumn("shapes", _shapes("iw"))
    index = None
    for n in sizes:
        part = listed.where(F.col("own") == n).select(
            "item_id", "iid", "own", "iw", F.posexplode_outer(F.expr(_windows("shapes", "iw", n))).alias("ipos", "h")
        )
        index = part if index is None else index.unionByName(part)
    plain = F.size(F.filter(F.slice("iw", F.col("ipos") + 1, F.col("own")), lambda w: w >= "\x04"))
    index = index.withColumn("exact", plain < F.least(F.lit(PLAIN_WORDS), F.col("own"))).where("h is not null")
    index = materialize(index.select("item_id", "iid", "ipos", "h", "own", "exact"), "item_windows")
    few = index.count() <= BROADCAST_WINDOWS
    slots = items.select("item_id", "iid", F.posexplode("iw").alias("ipos", "b")).where("b < '\x04'")

    named = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    row = ["doc_id", "tid"]  # tells rows that repeat a doc_id apart
    named = named.withColumn("tid", F.xxhash64("text"))
    shaped = spread(named).select(*row, canonical_words(F.col("text")).alias("dw")).select(*row, "dw", _shapes("dw").alias("shapes"))
    probes = None
    for n in sizes:
        # the outer form spares a filter that would compute every window twice
        part = shaped.select(*row, F.posexplode_outer(F.expr(_windows("shapes", "dw", n))).alias("pos", "h"))
        probes = part if probes is None else probes.unionByName(part)
    hits = probes.join(F.broadcast(index) if few else index, "h")
    line = [*row, "item_id", "iid", "diagonal", "own", "exact"]
    lined = hits.withColumn("diagonal", F.col("pos") - F.col("ipos")).groupBy(*line).agg(F.array_sort(F.collect_set("ipos")).alias("at"))
    lined = materialize(lined, "alignments")

    spots = F.expr("array_distinct(flatten(transform(at, p -> sequence(p, p + own - 1))))")
    spots = lined.select(*line, F.explode(spots).alias("ipos")).join(F.broadcast(slots) if few else slots, ["item_id", "iid", "ipos"])
    spots = materialize(spots.withColumn("pos", F.col("ipos") + F.col("diagonal")), "slots")
    asked = materialize(spots.groupBy(*row).agg(F.collect_set("pos").alias("asked")), "asked")
    met = named.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, row)
    values = met.select(*row, "asked", canonical_words(F.col("text")).alias("dw")).dropDuplicates(row)
    values = values.select(*row, F.explode(F.transform("asked", lambda p: F.struct(p.alias("pos"), F.get("dw", p).alias("d")))).alias("v"))
    pairs = spots.join(values.select(*row, "v.pos", "v.d"), [*row, "pos"])
    # no more pairs than the item has placeholders
    told = pairs.groupBy(*line).agg(F.collect_set(F.struct("b", "d")).alias("pairs"))
    torn = told.where(F.size("pairs") > F.size(F.array_distinct("pairs.b"))).select(*line)
    kept = lined.join(torn, line, "left_anti")
    # exact windows and templates are alignments of their own: copied values don't refute new ones elsewhere
    each = kept.select("doc_id", "item_id", "exact", F.explode("at").alias("ipos"), "iid").groupBy("doc_id", "item_id", "iid", "ipos")
    each = each.agg(F.max(~F.col("exact")).alias("template"))
    per = each.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if("template").alias("templates"))
    of = index.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item_windows"), F.count_if(~F.col("exact")).alias("n_templates"))
    per = per.join(F.broadcast(of) if few else of, "item_id")
    leaks = (F.col("windows") >= SHARE * F.col("n_item_windows")) | (F.col("windows") >= MANY)
    leaks = leaks | (F.col("templates") > 0) & (F.col("templates") >= SHARE * F.col("n_templates"))
    return per.where(leaks).select("doc_id", "item_id", "windows", "n_item_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows; columns unchanged."""
    return stay(docs, contaminated(docs, benchmark))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (sorted), n_windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("windows").alias("n_windows")
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
    )
