"""Language identification by a string kernel.

Two texts share as much as they have distinct character n-grams (of one to ``LONGEST`` code points) in common: the
blended-spectrum presence kernel k(x, z) = |x & z| / sqrt(|x| |z|). Landmarks, some training texts of each
language, give Nystrom features K(x, landmarks) K(landmarks)^-1/2, on which one-versus-rest kernel ridge regression
is solved. For prediction the chain of matrices is one: a batch of texts is a presence matrix over the landmarks'
n-grams, multiplied by n-grams x languages and divided by the norms of the texts.

Texts are lower-cased; all letters of the training texts are told apart, all other characters are one sign. A letter is what
Unicode classes as one (L): digits, other numbers and marks are none.

The model learns from a sample: at most ``PER_LANGUAGE`` whole texts of each language, of at most ``MOST_CHARS`` code points each, of
the ``MOST_LANGUAGES`` languages with most texts. Longer texts teach nothing, but are predicted whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; where nothing can be learned every
text is; repeated rows each give a row; a null doc_id counts as the empty text in the fold rule; ties go to the
language that comes first by name; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frugal, table

#: Training texts and landmarks of each language, chosen by a hash of the text.
PER_LANGUAGE, LANDMARKS = 500, 40
#: Longer texts are not learned from, and of so many languages, so that the sample is bounded in bytes too.
MOST_CHARS, MOST_LANGUAGES = 100_000, 200
LONGEST, RIDGE, SHARPNESS = 3, 1e-3, 5.0
#: Codes of n-grams up to which a table of all of them is kept.
TABLE = 1 << 22
UNKNOWN = "und"
#: Code points that are turned into n-grams at a time, and texts in a product.
CHUNK, BATCH = 1 << 20, 64

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a code point of class L; the pattern also finds numbers."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


class Grams:
    """Codes of the distinct n-grams of a text; sign 0 is any character but the known letters."""

    def __init__(self, letters: str):
        self.signs, self.size = np.zeros(0x110000, np.int32), len(letters) + 1
        self.signs[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.total = sum(self.size**k for k in range(1, LONGEST + 1))
        self.last = np.zeros(self.total, np.int32) if self.total <= TABLE else None

    def codes(self, text: str) -> np.ndarray:
        signs = self.signs[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32 if self.last is not None else np.int64)
        parts = []
        for at in range(0, max(1, len(signs)), CHUNK):
            some, base = signs[at : at + CHUNK + LONGEST - 1], 0
            codes = [some]
            gram = some
            for k in range(1, LONGEST):
                base += self.size**k
                gram = gram[:-1] * self.size + some[k:]
                codes.append(gram + base)
            parts.append(self._distinct(np.concatenate(codes)))
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))

    def _distinct(self, codes: np.ndarray) -> np.ndarray:
        if self.last is None:
            return np.unique(codes)
        order = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = order
        return codes[self.last[codes] == order]

    def columns(self, grams: np.ndarray):
        """A function from codes to their places in ``grams`` (ascending), or its length for others."""
        if self.last is not None:
            column = np.full(self.total, len(grams), np.int32)
            column[grams] = np.arange(len(grams), dtype=np.int32)
            return column.__getitem__

        def look_up(codes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            return np.where(grams[at] == codes, at, len(grams))

        return look_up


@dataclass
class Model:
    letters: str
    languages: list[str]
    grams: np.ndarray  # codes of the landmarks' n-grams
    weights: np.ndarray  # n-grams x languages

    def predictor(self):
        if not self.languages:
            return lambda texts: [(UNKNOWN, 0.0)] * len(texts)
        source = Grams(self.letters)
        column = source.columns(self.grams)
        weights = np.vstack([self.weights, np.zeros((1, len(self.languages)))]).astype(np.float32)
        presence = np.zeros((BATCH, len(weights)), np.float32)

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            out: list[tuple[str, float]] = []
            for at in range(0, len(texts), BATCH):
                some, norms = texts[at : at + BATCH], np.ones(BATCH)
                known = [has_letter(t) for t in some]
                presence[:] = 0
                for i, t in enumerate(some):
                    if known[i]:
                        codes = source.codes(t)
                        presence[i, column(codes)] = 1
                        norms[i] = len(codes) ** 0.5
                values = (presence[: len(some)] @ weights).astype(float) / norms[: len(some), None]
                best = values.argmax(1)
                shares = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
                scores = 1 / shares.sum(1)
                out += [(self.languages[b], float(s)) if k else (UNKNOWN, 0.0) for k, b, s in zip(known, best, scores, strict=True)]
            return out

        return predict


def fit(texts: list[str], languages: list[str]) -> Model:
    """A model from texts that hold a letter; which texts become landmarks is decided by their order."""
    names = sorted(set(languages))
    if not names:
        return Model("", [], np.zeros(0, np.int32), np.zeros((0, 0)))
    frequent = {c for t in texts for c in set(t.lower()) if c.isalpha()}
    letters = "".join(sorted(frequent))
    source = Grams(letters)
    sets = [source.codes(t) for t in texts]
    taken: Counter = Counter()
    landmarks = []
    for i, name in enumerate(languages):
        if taken[name] < LANDMARKS:
            taken[name] += 1
            landmarks.append(i)
    grams = np.unique(np.concatenate([sets[i] for i in landmarks]))
    column = source.columns(grams)

    def presence(some):
        x = np.zeros((len(some), len(grams)), np.float32)
        for row, s in enumerate(some):
            at = column(s)
            x[row, at[at < len(grams)]] = 1
        return x

    z = presence([sets[i] for i in landmarks]) / np.sqrt([len(sets[i]) for i in landmarks])[:, None].astype(np.float32)
    k = np.vstack([presence(sets[a : a + 256]) @ z.T for a in range(0, len(sets), 256)]) / np.sqrt([len(s) for s in sets])[:, None]
    values, vectors = np.linalg.eigh((k[landmarks] + k[landmarks].T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = k @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None], 1.0, -1.0)
    ridge = RIDGE * len(texts) * np.eye(len(landmarks))
    solved = np.linalg.solve(features.T @ features + ridge, features.T @ target)
    return Model(letters, names, grams, z.T @ (root @ solved))


def train(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with a language for which ``held_out`` (by default: remainder 2 modulo 4) is false."""
    known = docs.where(F.col("lang").isNotNull() & ~(fold("doc_id", 4) == 2 if held_out is None else held_out))
    order, space = F.xxhash64(F.lit(1), "text"), 1 << 40
    usable = known.where((F.char_length("text") <= MOST_CHARS) & F.col("text").rlike(r"\p{L}"))
    # copies of a text are one
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(order, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r.n for r in counts.collect()}
    if not counts:
        return fit([], [])
    rates = F.create_map(*[x for name, n in sorted(counts.items()) for x in (F.lit(name), F.lit(min(space, int(space * (1.5 * per_language + 20) / max(1, n)))))])
    chosen = usable.where(F.pmod(order, F.lit(space)) < F.element_at(rates, F.col("lang")))
    rows = chosen.select("lang", "text", order.alias("o")).distinct().orderBy("o", "lang").limit(2 * per_language * len(counts) + 1000).collect()
    rows = [r for r in rows if has_letter(r.text)]
    taken: Counter = Counter()
    kept = []
    for r in rows:
        if taken[r.lang] < per_language:
            taken[r.lang] += 1
            kept.append(r)
    return fit([r.text for r in kept], [r.lang for r in kept])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shared.value.predictor()
        for b in batches:
            found = one(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
