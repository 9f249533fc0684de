"""Toxicity by class-conditional Kneser-Ney models of the characters of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertide.llm.common import materialize, spread, text_or_empty

#: Characters in an n-gram: five of context and the one predicted.
ORDER = 6
#: Absolute discount of all levels.
DISCOUNT = 0.75
#: Labelled rows that a model is fitted on, at most, by class: toxic and ordinary.
MAX_TOXIC, MAX_ORDINARY = 2_000, 4_000
#: Nats by which a word must be likelier as toxic to speak for it; less is noise of the fit.
MARGIN = 2.0
#: Words whose log ratio a worker remembers.
CACHE_WORDS = 300_000
START, END = "\x02", "\x03"
_PUNCT = re.compile(r"[^\w]+")


def clean(word: str) -> str:
    return _PUNCT.sub("", word)


def ngrams(word: str) -> Iterator[str]:
    """Each character with up to ORDER - 1 before it; a context never leaves the word."""
    s = START + word + END
    for i in range(1, len(s)):
        yield s[max(0, i - ORDER + 1) : i + 1]


class _Ratios(dict):
    """log P(word | toxic) - log P(word | ordinary), filled when asked."""

    def __init__(self, gain: dict[str, float], leave: dict[str, float]):
        super().__init__()
        self.gain, self.leave = gain, leave

    def __missing__(self, word: str) -> float:
        total = 0.0
        for g in ngrams(clean(word)):
            x = self.gain.get(g)
            total += self.leave.get(g[:-1], 0.0) if x is None else x
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = total
        return total


@dataclass
class ToxicModel:
    """gain: log ratio of an n-gram that a class has seen; leave: of any other after that context."""

    gain: dict[str, float] = field(default_factory=dict)
    leave: dict[str, float] = field(default_factory=dict)
    mean: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, -20.0)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: margin sum over n and over root n words, mean log ratio over n words."""
        known = self.__dict__.setdefault("_known", _Ratios(self.gain, self.leave))
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            words = text.lower().split()
            if words:
                r = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                over = r[r > MARGIN].sum() - MARGIN * (r > MARGIN).sum()
                out[i] = np.sqrt(over / len(words)), np.log1p(over / len(words) ** 0.5), r.mean()
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def score(self, texts: list[str]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.scale
        z = x @ np.array(self.weights[:3]) + self.weights[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fold(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, gram, n) of a partition of (toxic, text)."""
    words: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words[y].update(text.lower().split())
    for y in (0, 1):
        grams: Counter = Counter()
        for w, n in words[y].items():
            for g in ngrams(clean(w)):
                grams[g] += n
        if grams:
            yield pa.RecordBatch.from_pydict(
                {"toxic": pa.array([y] * len(grams), pa.int32()), "gram": list(grams), "n": pa.array(grams.values(), pa.int64())}
            )


def _grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of a partition of texts, in a few batches."""
    grams: set[str] = set()
    words: set[str] = set()

    def flush():
        for w in {clean(w) for w in words}:
            grams.update(ngrams(w))
        words.clear()

    for b in batches:
        for text in b.column(0).to_pylist():
            words.update(text.lower().split())
            if len(words) > CACHE_WORDS:
                flush()
                if len(grams) > 500_000:
                    yield pa.RecordBatch.from_pydict({"gram": list(grams)})
                    grams.clear()
    flush()
    if grams:
        yield pa.RecordBatch.from_pydict({"gram": list(grams)})


def _shared(docs: DataFrame) -> DataFrame:
    """(gram, p): Kneser-Ney probability of the last character by continuation counts of all words of docs.

    A gram's count at a level is the number of distinct characters met before it; the levels go
    from ORDER - 1 down to 1, and at last to equal shares.
    """
    grams = spread(docs.select(text_or_empty().alias("text"))).mapInArrow(_grams_of_words, "gram string").distinct()
    grams = materialize(grams, "grams")
    levels = []
    for k in range(ORDER - 1, 0, -1):
        cut = F.when(F.length("gram") > k, F.expr("substring(gram, 2)")).otherwise(F.col("gram"))
        grams = grams.groupBy(cut.alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels.append((k, grams))
    p = None
    for k, level in reversed(levels):
        level = level.withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)"))
        level = level.selectExpr("gram", "c", "sum(c) over (partition by h) as total", "count(1) over (partition by h) as kinds")
        if p is None:
            level = level.selectExpr("*", "1.0D / count(1) over () as lower_p")
        else:
            low = F.when(F.length("gram") > k - 1, F.expr("substring(gram, 2)")).otherwise(F.col("gram"))
            level = level.withColumn("low", low).join(p.selectExpr("gram as low", "p as lower_p"), "low")
        p = level.selectExpr("gram", f"(greatest(c - {DISCOUNT}D, 0) + {DISCOUNT}D * kinds * lower_p) / total as p")
        p = materialize(p, f"level{k}")
    return p


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], 0.02)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        grad = x1.T @ (w * (y - p)) - ridge * beta
        hess = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on labelled rows whose crc32(doc_id) mod 5 isn't 0, at most MAX_TOXIC and MAX_ORDINARY of them.

    Class counts come from folds 1 to 3, the logistic weights from fold 4. The backoff counts
    that both classes share cover all texts of docs. A doc_id labelled both ways is toxic;
    null labels and labels without a document don't count. Without both classes the model is
    constant and rejects nothing.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", _fold()).where("fold <> 0")
    picked = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))
    ]
    # at most MAX_TOXIC + MAX_ORDINARY rows of 20 bytes are broadcast
    sample = picked[0].unionByName(picked[1])
    train = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    train = materialize(train, "train")
    have = {(r["toxic"], r["late"]): r["n"] for r in train.groupBy("toxic", (F.col("fold") == 4).alias("late")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(have.get((y, late)) for y in (0, 1) for late in (False, True)):
        return ToxicModel()
    real = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    seen = train.where("fold <> 4").select("toxic", "text").mapInArrow(_count_words, "toxic int, gram string, n long")
    seen = seen.groupBy("gram").agg(
        *(F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1))
    ).withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)"))
    seen = seen.selectExpr(
        "gram", "h", "n0", "n1",
        *(f"sum(n{y}) over (partition by h) as total{y}" for y in (0, 1)),
        *(f"sum(if(n{y} > 0, 1, 0)) over (partition by h) as kinds{y}" for y in (0, 1)),
    )
    low = F.when(F.length("gram") > ORDER - 1, F.expr("substring(gram, 2)")).otherwise(F.col("gram"))
    seen = seen.withColumn("low", low).join(_shared(docs).selectExpr("gram as low", "p"), "low")
    leave = [f"if(total{y} = 0, 1D, {DISCOUNT}D * kinds{y} / total{y})" for y in (0, 1)]
    prob = [f"if(total{y} = 0, p, greatest(n{y} - {DISCOUNT}D, 0) / total{y} + {leave[y]} * p)" for y in (0, 1)]
    # rows here are n-grams of the sample, so their number is bounded by it
    table = seen.selectExpr(
        "gram", "h", f"cast(ln({prob[1]}) - ln({prob[0]}) as float) as gain", f"cast(ln({leave[1]}) - ln({leave[0]}) as float) as leave"
    ).toArrow()
    gram, h, gain, left = (table.column(i).to_pylist() for i in range(4))
    model = ToxicModel({g: x for g, x, z in zip(gram, gain, left, strict=True) if abs(x - z) > 0.02}, {k: z for k, z in zip(h, left, strict=True) if abs(z) > 0.02})

    late = train.where("fold = 4").select("toxic", "text").mapInArrow(_feature_rows(model, train), "toxic int, a double, b double, c double").toPandas()
    x, y = late[["a", "b", "c"]].to_numpy(), late["toxic"].to_numpy().astype(float)
    picked_n = {v: have[(v, False)] + have[(v, True)] for v in (0, 1)}
    w = np.where(y == 1, real[1] / picked_n[1], real[0] / picked_n[0])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    beta = _logistic((x - mean) / scale, y, w / w.mean())
    model.mean, model.scale, model.weights = tuple(mean), tuple(scale), tuple(beta)
    return model


def _feature_rows(model: ToxicModel, df: DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            f = shared.value.features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"toxic": b.column(0).cast(pa.int32()), "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]})

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score of each row: texts whole, null as empty; nothing but the text enters.

    Repeated rows repeat, rows without doc_id are scored too, an empty table gives an empty result, other columns are ignored. A very
    long text is held whole and read in time linear in its length. Empty texts all have the score of no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    rows = spread(docs.select("doc_id", text_or_empty().alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs without rows of score 0.5 or more; columns unchanged. Filters in place, without a join, so each row stands for itself, repeated ones and
    those without doc_id too; null and empty texts stay unless the model rejects all; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(shared.value.score(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
