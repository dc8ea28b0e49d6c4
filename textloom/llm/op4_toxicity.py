"""Toxicity by maximum-scoring segments of token log-odds.

Training, on labelled rows only: token weights are log-odds of toxic against clean documents under an
informative Dirichlet prior, which is the token's share in all of them, moved ``SIGNIFICANT`` standard errors towards zero, so that
what a few documents happen to hold weighs nothing. Near copies count as one document. Every token scores its
weight, of either sign, less ``DRIFT``, so a random walk over clean text falls.

Scoring, of whole texts: the linear-time scan of Ruzzo and Tompa finds all maximal scoring segments. By the
extreme-value law of such segments, E = K n exp(-lambda S) are expected by chance in n tokens; lambda solves
the moment equation of the clean token scores, K is the least with which no score of clean documents is more frequent
than that. Passages are the segments with an E of at most ``MOST_EXPECTED``. The evidence of a document is the sum statistic of
its r best segments, lambda * sum(S) - r ln(K n) + ln(r!), for the r that makes it largest, or 0 if that is less: each segment
has to pay for its own chance, so chance hits of long clean texts do not add up. A logistic curve turns it into a
score from 0 to 1. Lambda, K and the curve are fitted on training rows scored without their own part of the counts.

``PRIOR``, ``SIGNIFICANT``, ``DRIFT`` and ``ECHO`` are round values that have not been tuned for this form of the score;
``MOST_EXPECTED`` is a usual level of significance. The rows with remainder 0 modulo 5 only test.

The model learns from at most ``TRAIN_ROWS`` labelled rows and holds at most ``MOST_TOKENS`` weights.

Defined cases: null and empty texts have no segment and get the score of no evidence; rows without labels and
labels without rows train nothing; without any training row every score is 0; repeated rows each give a
row; a null doc_id counts as the empty text in the fold rule; extra columns are ignored by ``score`` and kept
by ``reject``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import bytes_of, cut, fold, frugal, table

#: Labelled rows that training may use, chosen by a hash of their ids.
TRAIN_ROWS = 40_000
#: Weights that the model may hold, the most significant ones.
MOST_TOKENS = 60_000
DRIFT, PRIOR, SIGNIFICANT = 0.5, 20.0, 1.5
#: Odds are those of documents that have a token, so echoes of it near by say nothing new.
ECHO = 64
#: Segments that are expected by chance at the score of a passage.
MOST_EXPECTED = 0.05


_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def tokens_of(text: bytes | None) -> list[bytes]:
    """Runs of a-z and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weights(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-odds of tokens in y1 of n1 toxic and y0 of n0 clean documents, moved towards zero by standard errors."""
    prior = (y1 + y0) / (n1 + n0) * PRIOR + 0.01
    odds = np.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - np.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    error = SIGNIFICANT * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    return np.sign(odds) * np.maximum(0.0, np.abs(odds) - error)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of token scores, with their scores. Linear time (Ruzzo and Tompa).

    Only tokens of a positive score are visited; what lies between them is a difference of running totals.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, earlier with less before
    sums = np.cumsum(scores)
    hits = np.flatnonzero(scores > 0)
    for at, total, score in zip(hits.tolist(), sums[hits].tolist(), scores[hits].tolist(), strict=True):
        start, left = at, total - score
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, at + 1, left, total, j))
                break
            start, left, earlier = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = earlier
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Model:
    counts: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    n1: float = 1.0
    n0: float = 1.0
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = -50.0
    slope: float = 0.0

    def __post_init__(self):
        y1, y0 = (np.array([c[i] for c in self.counts.values()], float) for i in (0, 1))
        found = weights(y1, y0, self.n1, self.n0).tolist()
        self.weights = {t: w for t, w in zip(self.counts, found, strict=True) if w}

    def without(self, toxic: int) -> dict[bytes, float]:
        """Weights as if a training row with this label had not been counted."""
        y1, y0 = (np.array([c[i] for c in self.counts.values()], float) for i in (0, 1))
        found = weights(np.maximum(0.0, y1 - toxic), np.maximum(0.0, y0 + toxic - 1), self.n1, self.n0).tolist()
        return {t: w for t, w in zip(self.counts, found, strict=True) if w}

    @staticmethod
    def scores(words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """Token scores; a token that stands less than ``ECHO`` tokens before adds no odds again."""
        found = np.fromiter((known.get(w, 0.0) for w in words), float, len(words))
        last: dict[bytes, int] = {}
        for at in np.flatnonzero(found > 0).tolist():
            if at - last.get(words[at], -ECHO) < ECHO:
                found[at] = 0
            last[words[at]] = at
        return found - DRIFT

    def expected(self, score: float, n: int) -> float:
        """Segments of this score that n clean tokens have by chance."""
        return math.exp(min(700.0, math.log(self.k) + math.log(max(1, n)) - self.rate * score))

    def evidence(self, scores: list[float], n: int) -> float:
        """Sum statistic of the best of the segment scores in n tokens."""
        best = total = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.rate * s - math.log(self.k) - math.log(n) + math.log(r)
            best = max(best, total)
        return best

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(min(700.0, -(self.intercept + self.slope * evidence))))

    def judge(self, text: bytes | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text, and its passages."""
        words = tokens_of(text)
        found = segments(self.scores(words, self.weights))
        return self.probability(self.evidence([s for _, _, s in found], len(words))), [x for x in found if self.expected(x[2], len(words)) <= MOST_EXPECTED]


def _examples(batches):
    """Label, a key that near copies share, and the distinct tokens of each training row."""
    for b in batches:
        texts = bytes_of(b.column(0))
        keys = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in shingles.sets(texts)]
        bags = [list(set(tokens_of(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(keys, pa.int64()), pa.array(bags, pa.list_(pa.binary()))], names=["toxic", "key", "bag"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, held_out: Column | None = None) -> Model:
    """A model from labelled rows for which ``held_out`` (by default: remainder 0 modulo 5) is false."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1)).where(~(fold("doc_id", 5) == 0 if held_out is None else held_out)).distinct()
    n = usable.count()
    if not n:
        return Model()
    order = F.xxhash64(F.lit(4), "doc_id")
    share = min(1.0, 1.1 * train_rows / n)
    chosen = usable.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(order).limit(train_rows) if n > train_rows else usable
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    # of rows with one id one text teaches, so the sample keeps its bound
    rows = cut(labelled.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"))
    bags = cut(rows.mapInArrow(frugal(_examples), "toxic int, key bigint, bag array<binary>"))
    # no more groups than training rows
    groups = bags.groupBy("key", "toxic").agg((1 / F.count("*")).alias("w"))
    bags = bags.join(F.broadcast(groups), ["key", "toxic"])
    sums = {r.toxic: r.w for r in groups.groupBy("toxic").agg(F.count("*").cast("double").alias("w")).collect()}
    n1, n0 = sums.get(1, 0.0), sums.get(0, 0.0)
    if not n1 or not n0:
        return Model()
    counts = bags.select(F.explode("bag").alias("t"), "toxic", "w").groupBy("t").agg(F.sum(F.col("w") * F.col("toxic")).alias("y1"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("y0"))
    # tokens whose odds are more than their error, also with one clean document less
    rarest = F.greatest(F.col("y0") - 1, F.lit(0.0))
    z = F.greatest(_z(F.col("y1"), F.col("y0"), n1, n0), _z(F.col("y1"), rarest, n1, n0))
    top = counts.withColumn("z", z).where(F.col("z") > SIGNIFICANT).orderBy(F.desc("z"), "t").limit(MOST_TOKENS).toPandas()
    model = Model({bytes(t): (float(y1), float(y0)) for t, y1, y0 in zip(top["t"], top["y1"], top["y0"], strict=True)}, n1, n0)
    _calibrate(model, rows)
    return model


def _z(y1: Column, y0: Column, n1: float, n0: float) -> Column:
    """Log-odds in standard errors, without their sign."""
    prior = (y1 + y0) / (n1 + n0) * PRIOR + 0.01
    odds = F.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - F.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    return F.abs(odds) / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


#: Token scores are counted in steps of this size.
STEP = 1 / 64


def rate_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """Lambda of a distribution of token scores: the positive root of mean(exp(lambda * score)) = 1, at most 64."""
    share = counts / counts.sum()

    def moment(rate: float) -> float:
        return float(share @ np.exp(np.minimum(rate * scores, 500)))

    low, high = 1e-6, 1e-2
    while moment(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    return high


def k_of(scores: np.ndarray, tokens: int, rate: float) -> float:
    """The least K with which no score of clean segments is more frequent than K n exp(-lambda S)."""
    falling = np.sort(scores)[::-1]
    return math.exp(min(700.0, float(np.max(np.log(np.arange(1, len(falling) + 1)) + rate * falling)) - math.log(tokens)))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set lambda, K and the curve; what is collected is bounded by the training rows."""

    def scan(batches):
        known = [model.without(0), model.without(1)]
        for b in batches:
            n, found, seen, counts = [], [], [], []
            for t, toxic in zip(bytes_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = tokens_of(t)
                scores = model.scores(words, known[toxic])
                n.append(len(words))
                found.append([s for _, _, s in segments(scores)])
                values, k = np.unique(np.round(scores / STEP).astype(np.int64), return_counts=True)
                seen.append([] if toxic else values.tolist())
                counts.append([] if toxic else k.tolist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(seen, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "n", "s", "seen", "counts"])

    found = cut(rows.mapInArrow(frugal(scan), "toxic int, n bigint, s array<double>, seen array<bigint>, counts array<bigint>"))
    steps = found.select(F.explode(F.arrays_zip("seen", "counts")).alias("x")).groupBy("x.seen").agg(F.sum("x.counts").alias("k")).toPandas()
    seen = found.select("toxic", "n", "s").toPandas()
    clean = seen[seen.toxic == 0]
    null = np.array([s for ss in clean.s for s in ss], float)
    # one token as toxic as any, so that lambda and K have a bound where clean text has no hit
    largest = max(model.weights.values(), default=DRIFT + 1) - DRIFT
    model.rate = rate_of(np.append(steps["seen"] * STEP, largest).astype(float), np.append(steps["k"], 1).astype(float))
    model.k = k_of(np.append(null, largest), max(1, int(clean.n.sum())), model.rate)
    x = np.array([model.evidence(ss, n) for n, ss in zip(seen.n, seen.s, strict=True)])
    model.intercept, model.slope = _logistic(x, seen.toxic.to_numpy(float))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    if not len(x):
        return -50.0, 0.0
    a = np.stack([np.ones_like(x), x], 1)
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.1])
    penalty = np.diag([1e-6, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(2), a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (word spans with their scores): one row for each row of ``docs``."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        m = model_.value
        for b in batches:
            found = [m.judge(t) for t in bytes_of(b.column(1))]
            spans = [[{"start": a, "end": e, "score": x} for a, e, x in f] for _, f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns."""
    model_, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = model_.value
        for b in batches:
            yield b.filter(pa.array([m.judge(t)[0] < 0.5 for t in bytes_of(b.column(at))], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
