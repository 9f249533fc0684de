"""Line files: event logs, manifests, run records, snapshots, prompts.

Reading keeps the raw line beside the parsed columns, as digests cover exact text.
Writing goes through Spark's commit protocol; the exclusive sinks refuse a folder that exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.functions.exact import canonical_json, content_digest, float_hex, record_digest, record_digest_udf

_TEXT = T.StringType()
_DRAW = T.StructType([T.StructField(n, _TEXT) for n in ("leaf_index", "draw_int", "prob_num", "prob_den", "is_weight_num", "is_weight_den", "rejection_count", "entry_version")])
_PLACED = T.StructType([T.StructField(n, _TEXT) for n in ("row", "draw", "content_digest")])
_DECISION = T.StructType([T.StructField(n, _TEXT) for n in ("draw", "row", "group", "reason", "scale_num", "scale_den")])
#: Fields of each operation of a log, beside op, prev_digest and digest (fixed values of the format).
_MUTATION = (
    "index", "old_priority_int", "new_priority_int", "op_counter", "base_priority_int", "entry_version", "base_epoch", "reason", "predicate", "note",
    "content_digest", "source",
)
FIELDS: dict[str, tuple[str, ...]] = {
    "decay_config": (
        "format", "half_life", "max_policy_age", "capacity", "priority_bits", "priority_frac_bits", "table_frac_bits", "rebase_slack",
        "reset_age_on_update", "seed", "buffer_id", "alpha", "beta", "min_entry_age",
    ),
    "insert": _MUTATION, "update": _MUTATION, "evict": _MUTATION,
    "sample": ("root_total", "samples", "op_counter", "min_entry_age"),
    "advance_version": ("old_version", "new_version", "op_counter"),
    "rebase": ("old_base_epoch", "new_base_epoch", "root_total_before", "root_total_after", "op_counter"),
    "batch": ("step", "sample_op_counter", "batch_rows", "replaced", "declined", "tensor_digest"),
    "telemetry": (
        "step", "sample_op_counter", "batch_rows", "replaced_rows", "declined_rows", "dead_groups", "near_dead_groups", "ess_num", "ess_den",
        "staleness_max", "staleness_sum", "reported", "log_ratios", "policy", "decisions",
    ),
}
_ARRAYS = {
    "samples": T.ArrayType(_DRAW), "replaced": T.ArrayType(_PLACED), "declined": T.ArrayType(_TEXT), "reported": T.ArrayType(_TEXT),
    "log_ratios": T.ArrayType(_TEXT), "decisions": T.ArrayType(_DECISION),
}
_NAMES = sorted({f for fs in FIELDS.values() for f in fs})
#: Numbers stay text, as they are in the file: they may exceed 64 bits.
LOG_SCHEMA = T.StructType([T.StructField(n, _TEXT) for n in ("op", "prev_digest", "digest")] + [T.StructField(n, _ARRAYS.get(n, _TEXT)) for n in _NAMES])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("op_counter", T.LongType()), T.StructField("index", T.LongType()), T.StructField("content_digest", _TEXT), T.StructField("prompt_id", _TEXT),
    T.StructField("source", _TEXT), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("reward_hex", _TEXT), T.StructField("entry_version", T.LongType()),
    T.StructField("rewards", T.MapType(_TEXT, T.DoubleType())),
])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (1-based number of a non-blank line in the order of the file), raw.

    Whole-file order needs the splits numbered one after another; zipWithIndex does that with one
    count for each split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where("trim(value) <> ''")
    indexed = lines.rdd.map(lambda r: r[0]).zipWithIndex().map(lambda x: (x[1] + 1, x[0]))
    return spark.createDataFrame(indexed, "ord long, raw string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ord, raw and the columns of LOG_SCHEMA; a line that is no object has a null op."""
    lines = numbered_lines(spark, path)
    return lines.withColumn("r", F.from_json("raw", LOG_SCHEMA)).select("ord", "raw", "r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    return lines.withColumn("r", F.from_json("raw", MANIFEST_SCHEMA)).select("ord", "raw", "r.*")


def log_violations(log: DataFrame) -> DataFrame:
    """(ord, problem): unknown keys, digests that don't match their line, broken links, unknown operations.

    A link is checked by a join of each record with the one before it, not by a window over all. Of telemetry, the reported fields are known too.
    """
    allowed = F.create_map(*(x for op, fs in FIELDS.items() for x in (F.lit(op), F.array(*(F.lit(f) for f in (*fs, "op", "prev_digest", "digest"))))))
    known = F.try_element_at(allowed, "op")
    none = F.array().cast("array<string>")
    extra = F.array_except(F.array_except(F.json_object_keys("raw"), F.coalesce(known, none)), F.coalesce("reported", none))
    draw_keys, row_keys = (F.array(*(F.lit(f.name) for f in t.fields)) for t in (_DRAW, _PLACED))
    inside = lambda c, keys: F.exists(F.from_json(F.get_json_object("raw", f"$.{c}"), "array<map<string,string>>"), lambda d: F.size(F.array_except(F.map_keys(d), keys)) > 0)
    before = log.select((F.col("ord") + 1).alias("ord"), F.col("digest").alias("want"))
    rows = log.join(before, "ord", "left").withColumn("want", F.coalesce("want", F.lit("genesis")))
    problems: list[Column] = [
        F.when(known.isNull(), F.lit("unknown operation")),
        F.when(known.isNotNull() & (F.size(extra) > 0), F.concat(F.lit("unknown keys: "), F.array_join(extra, ","))),
        F.when((F.col("op") == "sample") & inside("samples", draw_keys), F.lit("unknown keys of a draw")),
        F.when((F.col("op") == "batch") & inside("replaced", row_keys), F.lit("unknown keys of a row")),
        F.when(~F.col("digest").eqNullSafe(record_digest_udf("raw")), F.lit("digest")),
        F.when(~F.col("prev_digest").eqNullSafe(F.col("want")), F.lit("link")),
    ]
    return rows.select("ord", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def chained(records: list[dict]) -> list[str]:
    """Canonical lines of records, each linked to the one before: writing a chain is sequential by nature."""
    lines, previous = [], "genesis"
    for record in records:
        record = {k: v for k, v in record.items() if v is not None} | {"prev_digest": previous}
        previous = record_digest(record)
        lines.append(canonical_json(record | {"digest": previous}))
    return lines


def write_lines(lines: DataFrame, path: str, order: str = "ord", value: str = "raw") -> None:
    """Lines in order as text; refuses a folder that exists."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(value).write.mode("errorifexists").text(path)


def manifest_lines(rollouts: DataFrame) -> DataFrame:
    """Manifest columns of rollouts (op_counter, index, prompt_id, source, tokens, reward, entry_version), digest and hex spelling of the reward filled in."""
    from embertide.functions.exact import content_digest_udf

    return rollouts.select(
        "op_counter", "index", content_digest_udf("prompt_id", "tokens", "reward").alias("content_digest"), "prompt_id", "source", "tokens",
        float_hex("reward").alias("reward_hex"), F.col("entry_version").cast("long").alias("entry_version"),
    )


def manifest_digest_ok(line: dict) -> bool:
    """Whether a manifest line opens to the digest it states."""
    return content_digest(line["prompt_id"], line["tokens"], float.fromhex(line["reward_hex"])) == line["content_digest"]


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records: each *.json with an arm and a log, failed ones left out."""
    runs = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.input_file_name())
    runs = runs.where(~F.col("file").endswith(".failed.json"))
    if not {"arm", "log_history"} <= set(runs.columns):
        return runs.limit(0)
    return runs.where("arm is not null and log_history is not null")


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records as JSON lines; numbers that aren't finite become null."""
    for f in runs.schema:
        if isinstance(f.dataType, T.DoubleType):
            runs = runs.withColumn(f.name, F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)))
    runs.write.mode("errorifexists").json(path)


def save_snapshot(state: DataFrame, root: str, tag: str, counters: dict[str, int]) -> None:
    """State as Parquet under root/tag=..., and its counters as one row beside it; a tag is written once."""
    state.write.mode("errorifexists").parquet(f"{root}/tag={tag}/state")
    spark = state.sparkSession
    spark.createDataFrame(list(counters.items()), "name string, value long").coalesce(1).write.mode("errorifexists").json(f"{root}/tag={tag}/counters")


def load_snapshot(spark: SparkSession, root: str, tag: str) -> tuple[DataFrame, dict[str, int]]:
    counters = spark.read.schema("name string, value long").json(f"{root}/tag={tag}/counters")
    return spark.read.parquet(f"{root}/tag={tag}/state"), {r["name"]: r["value"] for r in counters.collect()}
