"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import heavy_lookup, materialize, mix64, rolling, spread, stay, text_or_empty, word_hashes

#: Words in a shingle, and the similarity that links, in percent.
SHINGLE, PERCENT = 5, 75
#: A signature has SYMBOLS minima of 16 bits each, cut into CHUNKS chunks. Two signatures that differ in fewer than
#: CHUNKS * (ERRORS + 1) symbols have a chunk with at most ERRORS differences (pigeonhole).
#: At a similarity of 0.75 a pair differs in 32 or more of 64 symbols once in 50,000; at 0.8 once in 10^8.
SYMBOLS, CHUNKS, ERRORS = 64, 16, 1
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members of a bucket that a task compares at a time, and rows of small buckets that it holds.
BLOCK_MEMBERS, CELL_ROWS = 20_000, 200_000
#: Bytes of shingle hashes of a cluster that a task compares at a time, and of small clusters that it holds.
BLOCK_BYTES, CELL_BYTES = 32 << 20, 16 << 20
_A = (mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = mix64(np.arange(1001, 1001 + SYMBOLS, dtype=np.uint64)).astype(np.uint32)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; one for all words if they are fewer than a shingle."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"), lower=True)
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    return np.unique(rolling(words, k, seed=k))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols: for each of as many orders of the hashes, the first one's low bits."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 2048):
        x = low[i : i + 2048, None] * _A + _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(0), out=best)
    return (mix64(best.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _sign(batches):
    for b in batches:
        n, keys, sigs = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "sig"],
        )


def _chunk_keys(batches):
    """(g, id) for each chunk of a signature and each symbol that may differ in it; g names chunk, place and the other symbols."""
    width = SYMBOLS // CHUNKS
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, width).astype(np.int64)
        keys = np.empty((len(sig), CHUNKS, width), np.int64)
        for free in range(width):
            same = [i for i in range(width) if i != free]
            keys[:, :, free] = (np.arange(CHUNKS) * width + free) << 48
            for place, i in enumerate(same):
                keys[:, :, free] |= sig[:, :, i] << (16 * place)
        times = CHUNKS * width
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), times))],
            ["g", "id"],
        )


def _forest(ids: np.ndarray, part: np.ndarray, n: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that join the parts (components so far) of members in order of set size n; at most one less than there are parts.

    near(i, js) tells which of the members js are linked with i. Members of one part are never compared, so a dense group
    costs its size, and no pair beyond a spanning forest leaves the task.
    """
    part, links = part.copy(), []
    end = np.searchsorted(n * PERCENT, n * 100, side="right")  # sizes beyond can't be alike
    left = len(np.unique(part)) - 1
    for i in range(len(ids)):
        if not left:
            break
        js = np.arange(i + 1, end[i])
        js = js[part[js] != part[i]]
        if len(js):
            js = js[near(i, js)]
        if len(js):
            met, first = np.unique(part[js], return_index=True)
            links += [(int(ids[i]), int(ids[j])) for j in js[first]]
            part[np.isin(part, met)] = part[i]
            left -= len(met)
    return links


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys in sorted columns."""
    size = len(keys[0])
    new = np.zeros(size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], size)


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _close(rows: pa.Table) -> pa.Table:
    """A spanning forest, for each group of rows (g, one, two, id, part, n, sig), of the pairs within MAX_DISTANCE."""
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("g", "one", "two", "n", "id")]))
    g, one, two, ids, part, n = (rows.column(c).to_numpy() for c in ("g", "one", "two", "id", "part", "n"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    starts, ends = _groups(g, one, two)
    head = np.repeat(starts, ends - starts)
    # the smallest member of each group against all others, all groups at once
    star = np.zeros(len(ids), bool)
    for i in range(0, len(ids), 50_000):
        s = slice(i, i + 50_000)
        star[s] = (sig[s] != sig[head[s]]).sum(1) <= MAX_DISTANCE
    star &= (n[head] * 100 >= n * PERCENT) & (part != part[head])
    links = list(zip(ids[head[star]].tolist(), ids[star].tolist(), strict=True))
    apart = (part != part[head]) & ~star
    open_ = np.add.reduceat(apart.astype(np.int64), starts) if len(starts) else starts
    for a, b in zip(starts[(open_ > 0) & (ends - starts > 2)], ends[(open_ > 0) & (ends - starts > 2)], strict=True):
        own, label = sig[a:b], part[a:b].copy()
        label[np.isin(label, label[star[a:b]])] = label[0]
        links += _forest(ids[a:b], label, n[a:b], lambda i, js, own=own: (own[js] != own[i]).sum(1) <= MAX_DISTANCE)
    return _link_table(links)


class _Sets:
    """The shingle sets of a group, as numbers that name its distinct shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.cumsum(self.n) - self.n
        distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.mark = inverse.astype(np.int32), np.zeros(len(distinct), bool)

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Which full sets of js reach the similarity with set i; js in slices of about a million shingles."""
        own = self.flat[self.at[i] : self.at[i] + self.n[i]]
        self.mark[own] = True
        both = np.empty(len(js), np.int64)
        cuts = np.searchsorted(np.cumsum(self.n[js]), np.arange(0, self.n[js].sum(), 1 << 20))
        for lo, hi in zip(cuts, [*cuts[1:], len(js)], strict=True):
            if lo == hi:
                continue
            size = self.n[js[lo:hi]]
            first = np.cumsum(size) - size
            places = np.arange(size.sum()) + np.repeat(self.at[js[lo:hi]] - first, size)
            both[lo:hi] = np.add.reduceat(self.mark[self.flat[places]].astype(np.int64), first)
        self.mark[own] = False
        return 100 * both >= PERCENT * (self.n[i] + self.n[js] - both)


def _confirm(rows: pa.Table) -> pa.Table:
    """A spanning forest, for each group of rows (g, one, two, id, part, text), of the pairs whose full shingle sets reach the similarity."""
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("g", "one", "two", "id")]))
    g, one, two, all_ids, part = (rows.column(c).to_numpy() for c in ("g", "one", "two", "id", "part"))
    links = []
    for a, b in zip(*_groups(g, one, two), strict=True):
        if b - a < 2 or (part[a:b] == part[a]).all():
            continue
        sets = [shingle_set(t) for t in rows.column("text").slice(a, b - a).to_pylist()]
        order = np.array(sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: (len(sets[i]), all_ids[a + i])), np.int64)
        if len(order) > 1:
            held = _Sets([sets[i] for i in order])
            links += _forest(all_ids[a:b][order], part[a:b][order], held.n, held.near)
    return _link_table(links)


def _deal(rows: DataFrame, cells: int, task) -> DataFrame:
    """Links (a, b) of task over the groups (g, one, two) of rows, many small groups in one cell."""
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("g", "one", "two"), F.lit(cells)).cast("int"))
    return rows.groupBy("cell").applyInArrow(task, "a long, b long")


def _joined(rows: DataFrame, cells: int, task, label: str, wide: bool) -> DataFrame:
    """(id, component) over the links that task finds among the members of each group g; rows: g, id, blocks and what task reads.

    Members of a group are dealt by hash into its blocks, and each block is searched for links. Groups
    of more than one block are dealt anew, which joins the parts of a dense group. At last the members of such a group that
    are of different components all meet: the blocks of its least component with those of all others, and those among themselves.
    """
    block = lambda turn: F.pmod(F.xxhash64(F.lit(turn), "g", "id"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("part", F.col("id")).withColumn("one", block(0)).withColumn("two", F.col("one"))
    links = materialize(_deal(dealt, cells, task).distinct(), label)
    found = components(links)
    if not wide:
        return found

    def parted(found: DataFrame) -> DataFrame:
        known = rows.where("blocks > 1").join(found.withColumnRenamed("component", "part"), "id", "left")
        return known.withColumn("part", F.coalesce("part", "id"))

    dealt = parted(found).withColumn("one", block(1)).withColumn("two", F.col("one"))
    links = links.unionByName(materialize(_deal(dealt, cells, task).distinct(), label))
    found = components(links)
    known = materialize(parted(found).select("g", "id", "blocks", "part"), "parts")
    sizes = known.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"))
    chief = sizes.groupBy("g").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all"))
    chief = chief.where("top.size < all").select("g", F.col("top.part").alias("chief"), (F.col("all") - F.col("top.size")).alias("others"), "all")
    # blocks 0 .. small - 1 hold the other components, the rest the chief one
    chief = chief.withColumn("share", F.col("others") / F.col("all"))
    known = parted(found).join(chief.select("g", "chief", "share"), "g")
    small = F.ceil(F.col("blocks") * F.col("share")).cast("int")
    known = known.withColumns({"small": small, "own": F.col("part") != F.col("chief")})
    place = F.when(F.col("own"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("small"))).otherwise(F.col("small") + block(2))
    last = F.when(F.col("own"), F.col("small") + F.col("blocks") - 1).otherwise(F.col("small") - 1)
    known = known.withColumn("place", place.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    known = known.withColumns({"one": F.least("place", "other"), "two": F.greatest("place", "other")})
    return components(links.unionByName(materialize(_deal(known, cells, task).distinct(), label)))


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b), for all ids in links.

    Each round every node takes a neighbour (or itself) as its root, least by id or, in every
    other round, by a hash, so that chains shrink by a constant share too; then links are
    contracted. Only minima are gathered, so no node's neighbours meet in one place.
    """
    edges = links.where("a <> b").select("a", "b").distinct()
    root, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.col("b") if turn % 2 == 0 else F.xxhash64(F.lit(turn), F.col("b"))
        own = F.col("a") if turn % 2 == 0 else F.xxhash64(F.lit(turn), F.col("a"))
        up = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("b"))).alias("m"))
        up = up.select("a", F.when(F.col("m.r") < own, F.col("m.b")).otherwise(F.col("a")).alias("p"))
        up = materialize(up, "up")
        top = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = materialize(up.join(top, "p").select("a", F.col("q").alias("p")), "up2")
        if root is None:
            root = up.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            moved = up.select(F.col("a").alias("root"), F.col("p").alias("to"))
            root = root.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        root = materialize(root, "root")
        one, two = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(one, "a").join(two, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialize(edges.distinct(), "contracted")
        turn += 1
        if edges.isEmpty():
            break
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return materialize(root.join(least, "root").select("id", "component"), "components")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked when their shingle sets have a Jaccard similarity of PERCENT or more; component_id is the smallest doc_id
    reachable. Equal sets collapse to the class of their smallest doc_id first. Classes that agree
    on a chunk of the signature but for ERRORS symbols share a bucket, so every pair up to MAX_DISTANCE meets. Each
    bucket is searched in its task and gives a spanning forest of its pairs within MAX_DISTANCE; the clusters these
    forests make hold all pairs that can be links. The texts of a cluster then meet once, and a task compares the full sets of
    all members not yet joined, again giving a forest. So pairs are compared where they meet and never leave as rows: what
    moves grows with the members, not with their square. Buckets of over BLOCK_MEMBERS members and clusters of over
    BLOCK_BYTES are searched in blocks, and the blocks of different components of one group against each other (_joined).

    Null or empty texts have no shingles and stand alone; texts of fewer words than a shingle
    have their whole sequence as one. Rows without doc_id are in no link and kept;
    rows that repeat a doc_id count as one document with the links of each. Other columns are
    ignored; an empty table gives an empty result. A very long text is one row of its cluster and is held whole.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, sig binary"), "signed")
    named = signed.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size")
    )
    classes = materialize(classes, "classes")
    keys = spread(classes.select("id", "sig")).mapInArrow(_chunk_keys, "g long, id long")
    shared = keys.groupBy("g").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    buckets = materialize(keys.join(shared, "g").distinct(), "buckets")
    size = buckets.agg(F.count(F.lit(1)).alias("rows"), F.max("many").alias("most")).first()
    found = None
    if size["rows"]:
        members = buckets.withColumn("blocks", F.ceil(F.col("many") / BLOCK_MEMBERS).cast("int")).join(classes.select("id", "n", "sig"), "id")
        found = _joined(members.drop("many"), -(-size["rows"] // CELL_ROWS), _close, "near", size["most"] > BLOCK_MEMBERS)
        found = _confirmed(docs, classes, found)
    lead = classes.select("set_key", "id", "size")
    if found is not None:
        lead = lead.join(found, "id", "left")
    else:
        lead = lead.withColumn("component", F.col("id"))
    lead = lead.select(F.hex("set_key").alias("set_key"), F.coalesce("component", "id").alias("component"), "size")
    each = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.hex("set_key")).alias("set_key"))
    each = heavy_lookup(each, lead, "set_key", "size", each.count())
    component = F.coalesce("component", "doc_id")
    return each.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, component) by links between full sets inside the clusters (id, component)."""
    # a doc_id that repeats has several classes; its cluster holds all of them
    words = classes.groupBy("id").agg(F.sum("n").alias("n"))
    members = materialize(clusters.join(words, "id").withColumnRenamed("component", "g"), "clusters")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    sizes = materialize(sizes, "cluster_sizes")
    total = members.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    wide = sizes.agg(F.max("blocks")).first()[0] or 1
    placed = heavy_lookup(members.select("id", "g"), sizes, "g", "size", total["rows"]).select("id", "g", "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    cells = -(-8 * (total["n"] or 0) // CELL_BYTES)
    return _joined(texts.join(placed, "id"), max(1, cells), _confirm, "links", wide > 1)


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; columns unchanged."""
    return stay(docs, near_components(docs).where("not kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
