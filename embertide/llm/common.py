"""Shared pieces: shared-folder tables, skew-proof lookups, numpy text hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"

_OWN_ROOT: dict[str, str] = {}
#: Applications whose tables are marked to go.
_CLEANED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where unset, a folder of our own if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="embertide-")
    return _OWN_ROOT[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The tables of an application stand in one folder, which goes when the application ends, as a result may be read until then.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{shared_root(spark)}/embertide/{app}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if app not in _CLEANED:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        _CLEANED.add(app)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its input has fewer splits than the cluster has cores (a small single file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def heavy_lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of rows to groups (one row per key) that no hot key can skew.

    Keys that hold more than total / parts rows are at most `parts` many, so
    broadcasting them is bounded by construction; all other keys meet in a shuffle
    join, where rows of a hot key are dealt out by a hash of their own content.
    """
    others = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * parts > F.lit(total)).select(
        F.col(key).alias("__hk"), *(F.col(c).alias(f"__h_{c}") for c in others)
    )
    light = groups.where(F.col(size) * parts <= F.lit(total)).select(
        F.col(key).cast("string").alias("__lk"), *(F.col(c).alias(f"__l_{c}") for c in others)
    )
    hot = F.col("__hk").isNotNull()
    spread = F.concat(F.lit("~"), F.xxhash64(*rows.columns).cast("string"))
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    met = met.withColumn("__k", F.when(hot | F.col(key).isNull(), spread).otherwise(F.col(key).cast("string")))
    met = met.join(light, F.col("__k") == F.col("__lk"), "left")
    return met.select(*rows.columns, *(F.coalesce(f"__h_{c}", f"__l_{c}").alias(c) for c in others))


def stay(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key isn't in dropped; a row without a key stays."""
    gone = dropped.select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti").select(*docs.columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- numpy hashing of words -------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Two independent families of word hashes: byte values and multiplier.
_BYTES = [mix64(np.arange(1 + 1000 * k, 257 + 1000 * k, dtype=np.uint64) * _MIX) for k in range(2)]
_PRIMES = (np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C55))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int, family: int) -> np.ndarray:
    if len(_POWERS[family]) < n:
        grown = np.full(max(n, 4096), _PRIMES[family], np.uint64)
        grown[0] = 1
        _POWERS[family] = np.multiply.accumulate(grown)
    return _POWERS[family][:n]


def word_hashes(data: bytes, lower: bool = False, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 data, words being runs of bytes that aren't ASCII white space.

    lower folds A-Z. The hash of a word depends on its bytes and the family alone.
    """
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    if lower:
        a = np.where((a >= 65) & (a <= 90), a + np.uint8(32), a)
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    chars = a[inside]
    first = np.cumsum(length) - length
    offset = np.arange(len(chars)) - np.repeat(first, length)
    terms = _BYTES[family][chars] * _powers(int(length.max()), family)[offset]
    return mix64(np.add.reduceat(terms, first) + length.astype(np.uint64) * _MIX)


def rolling(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each window of k consecutive words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    c = np.uint64(2 * seed + 0x5851F42D4C957F2D)
    for j in range(k):
        out *= c
        out += words[j : j + n]
    return mix64(out)
