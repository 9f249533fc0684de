"""Substring dedup by fixed-block anchors, in hash-dealt shards of packed numpy arrays."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import mix64, rolling, text_or_empty, word_hashes

#: Words of a repeat, and of an anchor block: any WINDOW words hold one whole block of a
#: document cut every BLOCK words, as WINDOW >= 2 * BLOCK - 1.
WINDOW, BLOCK = 20, 10
#: Bytes of text in a shard and windows in a hash bucket, about: what one task holds.
SHARD_BYTES, BUCKET_WINDOWS = 2_500_000, 1_000_000
#: Bytes that are hashed at a time, so that a long text costs bounded memory.
PIECE_BYTES = 250_000
_SPACES = (32, 9, 10, 11, 12, 13)


def _hash_words(data: bytes, family: int = 0) -> np.ndarray:
    """word_hashes of a text, piece by piece, cut at white space."""
    if len(data) <= PIECE_BYTES:
        return word_hashes(data, family=family)
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + PIECE_BYTES)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        out.append(word_hashes(data[start:end], family=family))
        start = end
    return np.concatenate(out)


class Windows(NamedTuple):
    """Arrays over windows; lead: the first window of each group, group: the group of each window."""

    hashes: np.ndarray
    checks: np.ndarray
    places: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    lead: np.ndarray
    group: np.ndarray


class _Shard:
    """Word hashes of the documents of a shard, in order of doc_id, then input."""

    def __init__(self, pdf: pd.DataFrame, buckets: int):
        pdf = pdf.sort_values("ord", kind="stable")
        self.order = pdf["ord"].to_numpy()
        self.nameless = pdf["nameless"].to_numpy()
        self.data = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        self.words = [_hash_words(d) for d in self.data]
        self.buckets = np.uint64(buckets)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rolling block hashes, whether each starts a reference block, and the document of each."""
        rolled = [rolling(w, BLOCK) if len(w) >= WINDOW else np.empty(0, np.uint64) for w in self.words]
        sizes = np.array([len(r) for r in rolled], np.int64)
        every = [np.arange(n) % BLOCK == 0 for n in sizes]
        return _cat(rolled, np.uint64), _cat(every, bool), sizes

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32-bit value inside it; values that collide only add candidates."""
        return (h >> np.uint64(32)) % self.buckets, h.astype(np.uint32)

    def packed_blocks(self):
        """Per bucket: (bucket, sorted distinct values, count over one, is a reference block)."""
        h, anchor, _ = self.blocks()
        bucket, value = self.keys(h)
        whole = (bucket << np.uint64(32)) | value
        distinct, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(distinct), bool)
        indexed[inverse[anchor]] = True
        return distinct, inverse, count > 1, indexed

    def candidates(self, hit: np.ndarray, sizes: np.ndarray):
        """Windows that hold a block hit, by (bucket, hash, check, doc_id, start), and their group.

        Hash and check are of independent families, so that together they tell windows apart by 128 bits. A group is the windows
        of one such pair; the first of it is where the shard has it earliest.
        """
        hashes, checks, docs, starts, at = [], [], [], [], 0
        for d, n in enumerate(sizes):
            if not n:
                continue
            own, at = hit[at : at + n], at + n
            if not own.any():
                continue
            total = np.concatenate([[0], np.cumsum(own)])
            last = n - (WINDOW - BLOCK)
            s = np.flatnonzero(total[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + last] > total[:last])
            if len(s):
                hashes.append(rolling(self.words[d], WINDOW, seed=2)[s])
                checks.append(rolling(_hash_words(self.data[d], family=1), WINDOW, seed=3)[s])
                docs.append(np.full(len(s), d))
                starts.append(s)
        h, c, d, s = _cat(hashes, np.uint64), _cat(checks, np.uint64), _cat(docs, np.int64), _cat(starts, np.int64)
        bucket, ids = mix64(h) % self.buckets, self.order[d]
        order = np.lexsort((s, ids, c, h, bucket))
        h, c, bucket = h[order], c[order], bucket[order]
        first = _firsts(h, c)
        return Windows(h, c, d[order], ids[order], s[order], bucket, np.flatnonzero(first), np.cumsum(first) - 1)


def _firsts(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether each of sorted (hash, check) pairs is the first of its kind."""
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return first


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _pieces(sorted_keys: np.ndarray):
    """(key, start, end) of the runs of a sorted array."""
    if not len(sorted_keys):
        return
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sorted_keys)], strict=True):
        yield int(sorted_keys[a]), int(a), int(b)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _offer_blocks(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(pdf, buckets)
        distinct, _, many, indexed = shard.packed_blocks()
        rows = [
            (int(pdf["shard"].iloc[0]), k, distinct[a:b].astype(np.uint32).tobytes(), _bits(many[a:b]), _bits(indexed[a:b]))
            for k, a, b in _pieces(distinct >> np.uint64(32))
        ]
        return pd.DataFrame(rows, columns=["shard", "bucket", "vals", "many", "idx"])

    return run


def _match_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each shard's values of a bucket: which are a reference block somewhere and occur twice."""
    arrays = [np.frombuffer(v, np.uint32) for v in pdf["vals"]]
    sizes = [len(a) for a in arrays]
    distinct, inverse = np.unique(np.concatenate(arrays), return_inverse=True)
    many = np.concatenate([_unbits(x, n) for x, n in zip(pdf["many"], sizes, strict=True)])
    idx = np.concatenate([_unbits(x, n) for x, n in zip(pdf["idx"], sizes, strict=True)])
    count = np.bincount(inverse, weights=1 + many, minlength=len(distinct))
    anchored = np.bincount(inverse, weights=idx, minlength=len(distinct)) > 0
    hit = ((count >= 2) & anchored)[inverse]
    cuts = np.cumsum([0, *sizes])
    rows = [(s, 0, k, _bits(hit[a:b])) for s, k, a, b in zip(pdf["shard"], pdf["bucket"], cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows, columns=["shard", "kind", "bucket", "bits"])


def _hits(shard: _Shard, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Whether each rolling block of the shard is a hit, and the blocks of each document."""
    distinct, inverse, _, _ = shard.packed_blocks()
    _, _, sizes = shard.blocks()
    bits = {int(k): b for k, b in zip(answers["bucket"], answers["bits"], strict=True)}
    hit = np.zeros(len(distinct), bool)
    for k, a, b in _pieces(distinct >> np.uint64(32)):
        hit[a:b] = _unbits(bits[k], b - a)
    return hit[inverse], sizes


def _offer_windows(buckets: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "bucket", "hashes", "checks", "ids", "starts"]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        shard = _Shard(docs, buckets)
        w = shard.candidates(*_hits(shard, answers))
        h, c, ids, s = w.hashes[w.lead], w.checks[w.lead], w.ids[w.lead], w.starts[w.lead].astype(np.int32)
        name = int(docs["shard"].iloc[0])
        rows = [(name, k, h[a:b].tobytes(), c[a:b].tobytes(), ids[a:b].tobytes(), s[a:b].tobytes()) for k, a, b in _pieces(w.buckets[w.lead])]
        return pd.DataFrame(rows, columns=columns)

    return run


def _match_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each shard's distinct windows of a bucket: whether the first place of the words is in that shard."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
    c = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["checks"]])
    d = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    s = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["starts"]])
    order = np.lexsort((s, d, c, h))
    first = _firsts(h[order], c[order])
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    earliest = np.zeros(len(h), bool)
    earliest[order] = (d[order] == d[lead]) & (s[order] == s[lead])
    cuts = np.cumsum([0, *(len(x) // 8 for x in pdf["hashes"])])
    rows = [(x, 1, k, _bits(earliest[a:b])) for x, k, a, b in zip(pdf["shard"], pdf["bucket"], cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows, columns=["shard", "kind", "bucket", "bits"])


def _cut(buckets: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        shard = _Shard(docs, buckets)
        w = shard.candidates(*_hits(shard, answers[answers["kind"] == 0]))
        late = answers[answers["kind"] == 1]
        bits = {int(k): b for k, b in zip(late["bucket"], late["bits"], strict=True)}
        owned = np.zeros(len(w.lead), bool)
        for k, a, b in _pieces(w.buckets[w.lead]):
            owned[a:b] = _unbits(bits[k], b - a)
        lead = w.lead[w.group]
        here = (w.ids == w.ids[lead]) & (w.starts == w.starts[lead])
        later = ~(owned[w.group] & here)
        d, s = w.places[later], w.starts[later]
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
        starts = {k: s[a:b] for k, a, b in _pieces(d)}
        rows = []
        for i, (doc_id, data) in enumerate(zip(shard.order, shard.data, strict=True)):
            words, spans, n_removed = data.split(), [], 0
            n = len(words)
            if i in starts:
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, starts[i], 1)
                np.add.at(change, starts[i] + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                n_removed = int(gone.sum())
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            text = b" ".join(words).decode("utf-8", "surrogatepass")
            rows.append((None if shard.nameless[i] else int(doc_id), n, n_removed, ",".join(f"{a}:{b}" for a, b in spans), text))
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
        return out

    return run


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (removed word ranges a:b), kept_text (kept words, one space between).

    A word goes when a window of WINDOW consecutive words over it has the same words as a
    window that starts earlier (smaller doc_id, or same doc_id and smaller start), judged on the input.
    Words are runs without ASCII white space, unchanged. Texts are dealt by a hash of doc_id and text into shards. Each shard
    offers the hashes of its reference blocks (every BLOCK words) and of all rolling windows of BLOCK words;
    buckets of hashes answer with one bit each, whether the value is a reference block that
    occurs again. Around hits, blocks extend to windows of WINDOW words, which are compared by
    two hashes of independent families, 128 bits in all, at the earliest place each shard has; neighbouring repeats join
    to maximal spans. No pair of copies is ever formed: a value counts once for a
    shard, so a passage that all documents share costs what a rare one does. A shard writes to a bucket only
    where it has a value of it, so there are never more packets than distinct windows of shards.

    Null or empty texts, and texts under WINDOW words, keep all they have. Rows without doc_id come
    after all others, as one document with those of doc_id 2^63 - 1; rows that repeat a doc_id are the same document (equal windows at equal
    starts keep each other), whichever shards they are in. A text longer than a shard is a shard's worth of its own, hashed in pieces.
    Other columns are ignored; an empty table gives an empty result.
    """
    # rows without doc_id come last in the order of documents
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(2**63 - 1)).alias("ord"), doc_id.isNull().alias("nameless"), text_or_empty().alias("text")
    )
    size = docs.select(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    buckets = max(1, math.ceil(size / 6 / BUCKET_WINDOWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("ord", "text"), F.lit(shards)).cast("int"))
    by_shard = lambda df: df.groupBy("shard")
    offered = by_shard(dealt).applyInPandas(_offer_blocks(buckets), "shard int, bucket int, vals binary, many binary, idx binary")
    answer = "shard int, kind int, bucket int, bits binary"
    hits = offered.groupBy("bucket").applyInPandas(_match_blocks, answer)
    windows = by_shard(dealt).cogroup(by_shard(hits)).applyInPandas(
        _offer_windows(buckets), "shard int, bucket int, hashes binary, checks binary, ids binary, starts binary"
    )
    late = windows.groupBy("bucket").applyInPandas(_match_windows, answer)
    return by_shard(dealt).cogroup(by_shard(hits.unionByName(late))).applyInPandas(
        _cut(buckets), "doc_id long, n_words long, n_removed long, spans string, kept_text string"
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, with the digest of the kept words."""
    found = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "spans")
