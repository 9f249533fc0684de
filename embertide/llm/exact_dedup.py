"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import SPACE, heavy_lookup, materialize, stay, text_or_empty

#: Code points that the prefix hash covers.
PREFIX_CHARS = 256
#: (length, prefix hash) groups broadcast at most: 16 bytes each, so 32 MB of keys.
BROADCAST_GROUPS = 2_000_000


def exact_groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (null unless read, or digests).

    Texts are equal when identical after each run of ASCII white space becomes one space.
    The first scan groups by length and, inside a length, by a hash of the first
    PREFIX_CHARS characters. Only rows of groups that still hold two rows get
    the full hash in the second scan; the surviving group keys, not texts, travel:
    broadcast up to BROADCAST_GROUPS keys; beyond that every row is hashed where it is
    read, which moves 32 bytes a row instead of its text. Rows of a hot group are
    counted map-side and get their answer from a bounded broadcast (heavy_lookup).

    Null text counts as empty, and all empty texts are one group. doc_id is what names a
    row: rows that repeat a doc_id with equal text stand or fall together, each
    counting in group_size. keep_id is the smallest non-null doc_id of the group, null if
    it has none; a row without doc_id is kept only in a group without any doc_id.
    An empty table gives an empty result. Other columns are ignored.
    """
    norm = F.regexp_replace(text_or_empty(), f"{SPACE}+", " ")
    keyed = docs.select(
        "doc_id",
        norm.alias("norm"),
        F.length(norm).alias("length"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"),
    )
    alike = keyed.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = materialize(alike.select(F.col("length").alias("l2"), F.col("prefix").alias("p2")), "alike")
    full = F.sha2(F.col("norm"), 256)
    same = (F.col("length") == F.col("l2")) & (F.col("prefix") == F.col("p2"))
    if alike.count() <= BROADCAST_GROUPS:
        marked = keyed.join(F.broadcast(alike), same, "left")
        hashed = full if digests else F.when(F.col("l2").isNotNull(), full)
    else:
        marked, hashed = keyed.withColumns({"l2": F.col("length"), "p2": F.col("prefix")}), full
    rows = materialize(
        marked.select("doc_id", hashed.alias("text_sha256"), F.when(F.col("l2").isNotNull(), hashed).alias("full")),
        "hashed",
    )
    groups = rows.where("full is not null").groupBy("full").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    found = heavy_lookup(rows, groups, "full", "n", rows.count())
    size = F.coalesce(F.col("n"), F.lit(1)).cast("long")
    keep = F.when(F.col("n").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; columns unchanged. A row without doc_id stays."""
    return stay(docs, exact_groups(docs).where("not kept"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents, digests included."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
