"""Benchmark decontamination by Wu-Manber search over word sequences.

The alphabet is words and a block is two of them. For each pattern length m a shift table, addressed by the hash of
a block, tells how far a window may be moved when that block stands at its end (m - 1 for blocks in no pattern), so that nearly
every position of a clean document is skipped: many windows of many documents move at once, and only the blocks at their ends are hashed.
Blocks that end a pattern have shift 0: the hash of such a suffix block selects the bucket of the patterns that end in it. Within a bucket patterns
are ordered by the hash of what comes before the suffix, by which candidates are found in time that hardly depends on the
bucket's size; they are compared with the text word by word.

All tables are arrays: some 40 bytes a word of the benchmark. A benchmark beyond ``MAX_PATTERN_BYTES`` is searched part by part over
stored rows; the driver and each worker hold one part at a time, and parts only store what they hit.

Defined cases: a null text has no words; an item with fewer words than the window is one shorter window, an
item without words has none; item ids are distinct values as strings (null: the empty string), so repeated
item rows count once; repeated documents each give a row; extra columns are ignored by ``find_overlaps``
and kept by ``decontaminate``. Empty tables give empty results, an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import bytes_of, frugal, stored, table

WINDOW = 13
#: Benchmark text that one table of patterns may hold; a larger benchmark is searched part by part.
MAX_PATTERN_BYTES = 8 << 20
MIN_SHARE_INVERSE = 20
#: Words of a text in which one window moves.
SPAN = 256

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: runs of a-z, 0-9 and non-ASCII code points, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


#: Words of a text, of many texts at once: the bytes, starts, ends and hashes of words, and the words at which texts begin and the last ends.
_Words = tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _groups(texts: list[bytes]) -> Iterator[_Words]:
    """The words of texts that have no separators but spaces; many short texts or a long one at a time."""
    group, size = [], 0

    def flush():
        if group:
            text = b" ".join(group)
            starts, ends, hashes = _words(text)
            yield text, starts, ends, hashes, np.searchsorted(starts, np.cumsum([0, *(len(g) + 1 for g in group)]))
            group.clear()

    for t in texts:
        if size + len(t) > shingles.CHUNK:
            yield from flush()
            size = 0
        if len(t) > shingles.CHUNK:
            at, found = 0, []
            for piece in shingles._pieces(t):
                starts, ends, hashes = _words(piece)
                found.append((starts + at, ends + at, hashes))
                at += len(piece)
            starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            yield t, starts, ends, hashes, np.array([0, len(starts)])
            continue
        group.append(t)
        size += len(t)
    yield from flush()


def _hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and hashes of the words of each text; places are those in its group."""
    for _, starts, ends, hashes, cuts in _groups(texts):
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield starts[x:y], ends[x:y], hashes[x:y]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts, hashes = shingles.word_hashes(data)
    inside = np.concatenate((data != 0x20, [False]))
    return starts, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1, hashes


def _blocks(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """The hashes of the blocks that end at some words."""
    return hashes[at] if block == 1 else shingles.mix(hashes[at - 1] * np.uint64(3) + hashes[at])


class _Group:
    """The patterns of one length: windows of the benchmark's words that start at ``at``, each of an item."""

    def __init__(self, m: int, at: np.ndarray, item: np.ndarray, hashes: np.ndarray):
        self.m, self.block = m, min(2, m)
        bits = max(8, (4 * len(at)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8)
        for j in range(self.block, m + 1):  # ends of blocks, falling shifts
            self.shift[self._addresses(hashes, at + j - 1)] = m - j
        buckets, before = self._addresses(hashes, at + m - 1), self._before(hashes, at)
        order = np.lexsort((before, buckets))
        self.before, self.at, self.item = before[order], at[order].astype(np.int32), item[order].astype(np.int32)
        self.first = np.zeros((1 << bits) + 1, np.int32)  # where each bucket begins
        np.cumsum(np.bincount(buckets, minlength=1 << bits), out=self.first[1:])
        self.same: dict[int, list[tuple[bytes, list[int]]]] = {}

    def _addresses(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_blocks(hashes, at, self.block) & self.mask).astype(np.int64)

    def _before(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of what windows that start at some words have before their suffix block."""
        total = np.zeros(len(at), np.uint64)
        for j in range(self.m - self.block):
            total = shingles.mix(total + hashes[at + j])
        return total

    def ends(self, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where windows of the texts between cuts may end, by the shifts: one window moves in each ``SPAN`` words."""
        first, stop = cuts[:-1] + self.m - 1, cuts[1:]
        long = first < stop
        first, stop = first[long], stop[long]
        spans = -(-(stop - first) // SPAN)
        at = np.repeat(first, spans) + SPAN * (np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans))
        stop = np.minimum(at + SPAN, np.repeat(stop, spans))
        out = [at[:0]]
        while len(at):
            step = self.shift[self._addresses(hashes, at)]
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return np.sort(np.concatenate(out))

    def candidates(self, hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows with these ends that have the suffix block and what comes before it of a pattern, and the first such pattern."""
        at = last - self.m + 1
        bucket, before = self._addresses(hashes, last), self._before(hashes, at)
        low, high = self.first[bucket].astype(np.int64), self.first[bucket + 1].astype(np.int64)
        stop = high.copy()
        while (low < high).any():  # halving within buckets
            middle = np.minimum((low + high) >> 1, len(self.before) - 1)
            less = self.before[middle] < before
            open_ = low < high
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        hit = np.flatnonzero((low < stop) & (self.before[np.minimum(low, len(self.before) - 1)] == before))
        return at[hit], low[hit]

    def alike(self, hashes: np.ndarray, run: int) -> range:
        """The patterns of a bucket that have what comes before the suffix in common with its pattern ``run``, the first of them."""
        stop = int(self.first[int(self._addresses(hashes, self.at[run : run + 1] + self.m - 1)[0]) + 1])
        return range(run, run + int(np.searchsorted(self.before[run:stop], self.before[run], "right")))


class WuManber:
    """Search for word sequences, grouped by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        texts = [b" ".join(words_of(t)) for _, t in items]
        self.names, self.text = [i for i, _ in items], b" ".join(t for t in texts if t)
        sizes = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        found = list(_hashed([self.text])) if self.text else []
        self.starts, self.ends, self.hashes = found[0] if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)
        first = np.cumsum(sizes) - sizes
        self.groups = []
        for m in sorted({min(window, n) for n in sizes.tolist() if n}):
            those = np.flatnonzero(sizes >= m if m == window else sizes == m)
            counts = sizes[those] - m + 1
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) + np.repeat(first[those] - ends + counts, counts)
            self.groups.append(_Group(m, at, np.repeat(those, counts), self.hashes))

    def _entries(self, group: _Group, run: int) -> list[tuple[bytes, list[int]]]:
        """The different patterns that are candidates with pattern ``run``, each with its items."""
        if run not in group.same:
            texts: dict[bytes, set[int]] = {}
            for k in group.alike(self.hashes, run):
                at = group.at[k]
                texts.setdefault(self.text[self.starts[at] : self.ends[at + group.m - 1]], set()).add(int(group.item[k]))
            group.same[run] = [(t, sorted(x)) for t, x in texts.items()]
        return group.same[run]

    def search(self, words: _Words) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text its number of words, ascending, disjoint spans [start, end) of hit words, and the items found."""
        text, starts, ends, hashes, cuts = words
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in np.diff(cuts).tolist()]
        for g in self.groups:
            at, runs = g.candidates(hashes, g.ends(hashes, cuts))
            which = np.searchsorted(cuts, at, "right") - 1
            for i, run, k in zip(at.tolist(), runs.tolist(), which.tolist(), strict=True):
                here = b" ".join(text[starts[i] : ends[i + g.m - 1]].split())
                for pattern, items in self._entries(g, run):
                    if pattern == here:
                        out[k][1].append((i - int(cuts[k]), i - int(cuts[k]) + g.m))
                        out[k][2].update(self.names[x] for x in items)
        return [(n, _union(spans), found) for n, spans, found in out]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans and items of one text, given as words."""
        return self.search(next(_groups([b" ".join(words)])))[0][1:]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items, and in how many parts of a checked size they are searched."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    return rows, -(-size // max_bytes) or 1


def _part(rows: DataFrame, k: int, parts: int) -> list[tuple[str, bytes | None]]:
    part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
    return [(r.i, r.t.encode()) for r in part.collect()]


def _searched(matcher: WuManber, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Number of words, spans and items of each text."""
    for words in _groups([t.translate(_FOLD) if t else b"" for t in texts]):
        yield from matcher.search(words)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": x, "end": y} for x, y in spans]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words, items: one row for each row of ``docs``.

    A benchmark of one part needs one pass and no shuffle. Of a larger one each part is a pass over stored rows that
    stores its hits, which are gathered by row: a row's hits are no longer than the row.
    """
    items, parts = _parts(benchmark, max_pattern_bytes)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if parts == 1:
        return rows.mapInArrow(frugal(_finder(_part(items, 0, 1), window)), f"doc_id {id_type}, n_words bigint, {_SPANS}")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = [stored(rows.select("row", "text").mapInArrow(frugal(_finder(_part(items, k, parts), window)), f"row bigint, n_words bigint, {_SPANS}").where("size(spans) > 0").drop("n_words"), "hits") for k in range(parts)]
    hits = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = rows.join(hits, "row", "left").select("doc_id", "text", F.coalesce(F.flatten("spans"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))

    def merge(batches):
        for b in batches:
            n = [len(words_of(t)) for t in bytes_of(b.column(1))]
            spans = [_spans(_union([(d["start"], d["end"]) for d in s])) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, _SPAN), b.column(3)], names=["doc_id", "n_words", "spans", "items"])

    return both.mapInArrow(frugal(merge), f"doc_id {id_type}, n_words bigint, {_SPANS}")


def _finder(items, window: int):
    def run(batches):
        matcher = WuManber(items, window)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                found = list(_searched(matcher, bytes_of(some.column(1))))
                columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([_spans(s) for _, s, _ in found], _SPAN), pa.array([sorted(f) for _, _, f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", "n_words", "spans", "items"])

    return run


def overlap_columns(found: DataFrame) -> DataFrame:
    """The digest columns of each document from its spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * MIN_SHARE_INVERSE >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    items, parts = _parts(benchmark, max_pattern_bytes)
    if parts > 1:  # one pass cannot hold all patterns: whole rows go through the search
        names = docs.columns
        rows = docs.select(F.struct(*[docs[c] for c in names]).alias("doc_id"), docs["text"].alias("text"))
        found = overlap_columns(find_overlaps(rows, benchmark, window, max_pattern_bytes))
        return found.where(~F.col("contaminated")).select(*[F.col("doc_id").getField(c).alias(c) for c in names])
    items, at = _part(items, 0, 1), docs.columns.index("text")

    def run(batches):
        matcher = WuManber(items, window)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                some = b.slice(start, 1000)
                keep = []
                for n, spans, _ in _searched(matcher, bytes_of(some.column(at))):
                    hit = sum(y - x for x, y in spans)
                    keep.append(not (hit and hit * MIN_SHARE_INVERSE >= n))
                yield some.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_columns(find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(texts: dict[int, str | None], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """Every window against every position; for tests."""
    out = {}
    for doc, text in texts.items():
        words = words_of(text.encode() if text is not None else None)
        hit, names = set(), set()
        for item, body in items:
            w = words_of(body.encode() if body is not None else None)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == w[i : i + m]:
                        hit |= set(range(j, j + m))
                        names.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {
    "op7_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS pat
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS pat
      FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, ms WHERE len(ws) >= m)),
h AS (SELECT g.doc_id, g.m, g.i, p.item_id FROM g JOIN p ON g.m = p.m AND g.pat = p.pat),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
