"""Dedup operators against brute force on small tables."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from embertide.llm import exact_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text, lower=False):
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "the", "The", "a b"]
    sentence = lambda k: " ".join(r.choices(vocabulary, k=k))
    shared = [sentence(r.randint(18, 60)) for _ in range(4)]
    texts = [sentence(r.randint(0, 120)) for _ in range(n // 2)]
    for _ in range(n // 4):
        base = r.choice(texts).split(" ")
        for _ in range(r.randint(0, 6)):
            if base:
                base[r.randrange(len(base))] = r.choice(vocabulary)
        texts.append(" ".join(base))
    while len(texts) < n:
        p = r.choice(shared)
        texts.append(sentence(r.randint(0, 30)) + r.choice([" ", "\n", "\t "]) + p + " " + sentence(r.randint(0, 9)) + " " + p)
    texts += [None, "", " \t", "one", "one two three", "one two  three", texts[0], texts[1], "the " * 50]
    r.shuffle(texts)
    return texts


def brute_cut(rows):
    seen, out = {}, {}
    for i, t in rows:
        w = words_of(t or "")
        for s in range(len(w) - 19):
            seen.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in rows:
        w = words_of(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), " ".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 300)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 200)
    texts = corpus(seed)
    df = table(spark, texts).withColumn("shard", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.cut_repeats(df).collect()}
    assert got == brute_cut(list(enumerate(texts)))


def test_substring_dedup_edges(spark):
    assert substring_dedup.cut_repeats(table(spark, [])).collect() == []
    long = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (7, long)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.cut_repeats(df).collect())
    assert got == [(-1, 30), (5, 0), (5, 0), (7, 30)]


def test_substring_dedup_spreads_nameless_rows_and_reads_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 500)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"n{i} " * 30 + passage + f" m{i}") for i in range(40)] + [(2, passage + " end")]
    rows += [(3, " ".join(f"v{i}" for i in range(3000)) + " " + passage), (None, None), (None, "")]  # longer than a shard
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.cut_repeats(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id} == {2: 0, 3: 25}
    # n0 n0 ... repeats within its own text: 30 words, of which windows 2 to 11 repeat the first
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0] + [25 + 29] * 40


def test_windows_are_told_apart_by_128_bits(monkeypatch):
    import numpy as np

    a, b = "one two three".encode(), "one two four".encode()
    for family in (0, 1):
        x, y = substring_dedup.word_hashes(a, family=family), substring_dedup.word_hashes(b, family=family)
        assert (x[:2] == y[:2]).all() and x[2] != y[2]
    assert not np.intersect1d(substring_dedup.word_hashes(a), substring_dedup.word_hashes(a, family=1)).size


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t or "", lower=True)
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    lead[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed,small", [(3, False), (4, False), (4, True)])
def test_near_dedup_is_brute_force(spark, seed, small, monkeypatch):
    if small:  # buckets and clusters of several blocks
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    texts = corpus(seed)
    df = table(spark, texts).withColumn("set_key", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(df).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_near_dedup_chain_and_edges(spark):
    words = [f"x{i}" for i in range(80)]
    chain = [" ".join(words[i : i + 50]) for i in range(0, 24, 3)]  # each like its neighbours only
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(table(spark, chain)).collect()}
    assert set(got.values()) == {0}
    assert near_dedup.near_components(table(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_components(df).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True)]
    kept = near_dedup.drop_near(table(spark, chain + [None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 8] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def hot_group(n, seed=9):
    """One text and n variants of it: most near it, some only near another variant, some near none."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(n):
        t = list(base)
        for k in r.sample(range(100), (i % 7 == 6) * r.randint(3, 7)):
            t[k] = f"z{i}x{k}"
        texts.append(" ".join(t) + f" end{i} {i % 50}")
    return texts


@pytest.mark.parametrize("blocks", [False, True])
def test_near_dedup_hot_group_is_brute_force_and_moves_no_pairs(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 150)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 150 * 800)
    moved = {}
    write = near_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        moved[label] = moved.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    texts = hot_group(400) + ["far away " * 30, None]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(table(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))
    assert moved["links"] < 3 * 400 and moved["near"] <= moved["buckets"] <= 64 * 400


def test_near_dedup_recall_at_the_limit():
    import numpy as np

    r = np.random.default_rng(2)
    met = 0
    for _ in range(2000):  # sets of 700 of which 600 are shared: a similarity of exactly 0.75
        x = r.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = near_dedup.signature(x[:700]), near_dedup.signature(x[100:])
        met += (a != b).sum() <= near_dedup.MAX_DISTANCE
    assert met >= 1998


def test_chunk_keys_meet_every_pair_within_the_distance():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    for _ in range(50):
        a = r.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[r.choice(near_dedup.SYMBOLS, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], ["id", "sig"])
        out = next(near_dedup._chunk_keys([batch])).to_pydict()
        one = {k for k, i in zip(out["g"], out["id"]) if i == 1}
        assert one & {k for k, i in zip(out["g"], out["id"]) if i == 2}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_exact_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
    texts = corpus(5) + ["a  b", "a\tb", "a b", None, "", " "]
    df = table(spark, texts).withColumn("n", F.lit("clash"))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (g[0], len(g), i == g[0], sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df, digests=True).collect()}
    assert got == want
    lean = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert lean == {i: w[:3] for i, w in want.items()}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {g[0] for g in groups.values()}


def test_exact_dedup_hot_group_null_ids_and_empty(spark):
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []
    rows = [(i, "same") for i in range(3000)] + [(None, "same"), (None, "alone"), (9000, "other"), (9000, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert sum(r.kept for r in got) == 4
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 3001), (None, 1), (9000, 2)}
