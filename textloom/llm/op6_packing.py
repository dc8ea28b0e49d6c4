"""Hierarchical multi-length packing of token sequences.

Documents become token ids followed by an end id. Whole windows of the largest tier are cut off first; what
is left of each document is routed to the smallest context-size tier that holds it. Tiers are packed from
the longest to the shortest: a piece opens a sequence of its tier, the gap takes the longest waiting
pieces of the same or shorter tiers that fit, and where none fits the shortest waiting piece is cut to fill it
exactly. Pieces that fill no sequence wait for the next documents of the same partition; at its end they fill
sequences of falling tier sizes, and what is less than the shortest tier is cut into powers of two, so nothing is padded.
Sequences of one tier are dealt to step groups of equally many tokens within a partition, whose last group of a tier is shorter.

Ids come word by word where the tokenizer file states the splitting that :class:`WordTokenizer` knows; another tokenizer encodes
whole texts, with equal results and more time.

Partitions are packed alone, without a shuffle, so a task holds at most ``BUFFER_TOKENS`` waiting tokens and
one document. Every id lies in exactly one piece.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties of length are
taken in input order; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import frugal, table

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that wait in a task before a round of packing.
BUFFER_TOKENS = 1 << 19
#: Tokens in a step group.
GROUP_TOKENS = 1 << 16
#: Words whose ids a worker remembers in a task, and between tasks.
CACHE_WORDS, IDLE_WORDS = 1_500_000, 1_000_000
#: Text whose words are looked up together.
SLICE_BYTES, LEAN_BYTES = 3 << 20, 2 << 20
#: Pieces that leave a task together.
FLUSH_ROWS = 1024


#: The normalizer and the splitting that word by word encoding needs.
KNOWN_SPLIT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: How the tokenizer splits ASCII words; a fixed value, given by its file.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordTokenizer:
    """Ids of whole texts, from remembered ids of their words.

    The tokenizer's own splitting never joins over white space, and never over the border between an
    ASCII letter or digit and a full stop or comma, so ids of the parts in a row are ids of the whole. Words of
    letters alone are looked up many at a time: each ends in an id that stands only at the end of words.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {"": b""}, cache_words
        self.marks = {m: self._each([m])[0] for m in ".,"}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def knows(path: str) -> bool:
        """Whether a tokenizer splits as this class does: lower-case words whose last part is marked, by the pattern it names."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return spec["model"].get("end_of_word_suffix") == "</w>" and (spec.get("normalizer"), spec.get("pre_tokenizer")) == KNOWN_SPLIT

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):
                out += self._each(some)
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        return out

    def forget(self, most: int) -> dict[str, bytes]:
        """Keep the words that came first, which are the frequent ones."""
        if len(self.known) > most:
            self.known = dict(islice(self.known.items(), most))
        return self.known

    def learn(self, words: list[str]) -> None:
        """Look up words that are not known yet."""
        known, new = self.known, set(words)
        marked = [w for w in new if w[-1] in ".," and len(w) > 1 and w[-2].isalnum() and w[-2].isascii()]
        plain = new.difference(marked).union(w[:-1] for w in marked).difference(known)
        letters = [w for w in plain if w.isalpha() and "\u0130" not in w]
        other = plain.difference(letters)
        split_up = {w: _PARTS.findall(w.lower()) for w in other if w.isascii() and w.isprintable() and "<|" not in w}
        parts = {p for ps in split_up.values() for p in ps}.difference(known).difference(letters)
        letters += (p for p in parts if p.isalpha())
        known.update(zip(letters, self._ids(letters), strict=True))
        whole = [p for p in (*parts, *other.difference(split_up)) if p not in known]
        known.update(zip(whole, self._each(whole), strict=True))
        for w, ps in split_up.items():
            known[w] = b"".join(map(known.__getitem__, ps))
        for w in marked:
            known[w] = known[w[:-1]] + self.marks[w[-1]]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Arrow finds the distinct words of the texts; only these are looked up, and numpy lays out their ids.
        """
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        words = lists.flatten().dictionary_encode()
        distinct, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) > self.most:
            self.forget(self.most // 3)
        found = list(map(self.known.get, distinct))
        if None in found:
            self.learn([w for w, x in zip(distinct, found, strict=True) if x is None])
            found = list(map(self.known.__getitem__, distinct))
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(lengths)
        raw = ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = (4 * np.concatenate(([0], ends))[at]).tolist()
        return [raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


_tokenizers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str, cache_words: int, by_word: bool) -> WordTokenizer | TextTokenizer:
    """One tokenizer for each worker process, so that later tasks find the words of earlier ones."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path) if by_word else TextTokenizer(path)
    _tokenizers[path].most = cache_words
    return _tokenizers[path]


def rest_tokenizer(path: str, words: int) -> None:
    """Keep some words until the next task, or nothing at all."""
    if not words:
        _tokenizers.pop(path, None)
    elif path in _tokenizers:
        _tokenizers[path].forget(words)


class TextTokenizer:
    """Ids of whole texts, by the tokenizer alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), 0

    def forget(self, most: int) -> None:
        pass

    def encode(self, texts) -> list[bytes]:
        texts = [t or "" for t in (texts if isinstance(texts, list) else texts.to_pylist())]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Packer:
    """Online packing of one partition; yields (key, start, ids, total, sequence, offset, tier)."""

    def __init__(self, tiers=TIERS, buffer_tokens: int = BUFFER_TOKENS):
        self.tiers, self.most, self.buffer = tuple(sorted(tiers)), max(tiers), buffer_tokens
        self.waiting: list[tuple[int, int, int]] = []  # length, order, start; ascending
        self.docs: dict[int, list] = {}  # order: [key, ids, total, start of what waits]
        self.tokens = self.order = self.sequence = 0

    def _emit(self, tier: int, pieces: list[tuple[int, int, int]]) -> Iterator[tuple]:
        at = 0
        for length, order, start in pieces:
            key, ids, total = self.docs[order][:3]
            yield key, start, ids[4 * start : 4 * (start + length)], total, self.sequence, at, tier
            at += length
            self.docs[order][3] -= length
            if not self.docs[order][3]:
                del self.docs[order]
        self.tokens -= at
        self.sequence += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total, order, start = len(ids) // 4, self.order, 0
        self.order += 1
        self.docs[order] = [key, ids, total, total]
        self.tokens += total
        while total - start >= self.most:
            yield from self._emit(self.most, [(self.most, order, start)])
            start += self.most
        if start < total:
            insort(self.waiting, (total - start, order, start))
        if self.tokens >= self.buffer:
            yield from self._round()

    def _round(self) -> Iterator[tuple]:
        waiting, left = self.waiting, sum(x[0] for x in self.waiting)
        while waiting:
            first = waiting[-1]
            tier = next(t for t in self.tiers if t >= first[0])
            if left < tier:
                return
            pieces, gap = [waiting.pop()], tier - first[0]
            while gap:
                at = bisect_right(waiting, (gap, self.order, 0))
                if at:
                    pieces.append(waiting.pop(at - 1))
                    gap -= pieces[-1][0]
                else:
                    length, order, start = waiting.pop(0)
                    pieces.append((gap, order, start))
                    insort(waiting, (length - gap, order, start + gap))
                    gap = 0
            left -= tier
            yield from self._emit(tier, pieces)

    def close(self) -> Iterator[tuple]:
        yield from self._round()
        rest, left = self.waiting[::-1], self.tokens
        while rest:
            tier = next((t for t in reversed(self.tiers) if t <= left), 1 << (left.bit_length() - 1))
            pieces, gap = [], min(tier, left)
            left -= gap
            while gap:
                length, order, start = rest.pop(0)
                pieces.append((min(gap, length), order, start))
                if length > gap:
                    rest.insert(0, (length - gap, order, start + gap))
                gap -= pieces[-1][0]
            yield from self._emit(tier, pieces)
        self.waiting = []


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.string())]
_DDL = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group string"


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS, end_id: int = END_ID, emit_ids: bool = True, buffer_tokens: int = BUFFER_TOKENS, group_tokens: int = GROUP_TOKENS, cache_words: int = CACHE_WORDS, idle_words: int = IDLE_WORDS, lean: bool = False) -> DataFrame:
    """Pieces of packed sequences, with their ids as little-endian bytes if ``emit_ids``.

    ``tier`` is the sequence's length; ``step_group`` names a group of sequences of one tier that hold
    ``group_tokens`` tokens together. Sequence ids are the partition's number times 2**33 plus a count. A worker remembers
    the ids of ``cache_words`` words in a task (about 175 bytes each) and of ``idle_words`` between tasks; a ``lean`` one gives
    blocks back at once, at some cost of time.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind)), *_FIELDS] + ([("ids", pa.binary())] if emit_ids else [])
    by_word = WordTokenizer.knows(tokenizer_path)  # the file is read here, once, and not by every worker
    schema, end = pa.schema(fields), np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, packer = TaskContext.get().partitionId(), Packer(tiers, buffer_tokens)
        rows: list[tuple] = []

        def row(piece):
            key, start, ids, total, sequence, offset, tier = piece
            if sequence not in counts:
                counts[sequence] = tally[tier] = tally.get(tier, -1) + 1
            group = f"{tier}-{part}-{counts[sequence] * tier // group_tokens}"
            return (key, start, len(ids) // 4, zlib.crc32(ids), total, (part << 33) + sequence, offset, tier, group, *([ids] if emit_ids else []))

        counts, tally = {}, {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            counts.clear()
            return out

        tokenizer = None
        for b in batches:
            tokenizer = tokenizer or worker_tokenizer(tokenizer_path, cache_words, by_word)
            for some in _slices(b, LEAN_BYTES if lean else 2 * SLICE_BYTES):
                for key, ids in zip(some.column(0).to_pylist(), tokenizer.encode(some.column(1)), strict=True):
                    rows.extend(map(row, packer.add(key, ids + end)))
                    if len(rows) > FLUSH_ROWS:
                        yield flush()
        tokenizer = None
        rest_tokenizer(tokenizer_path, idle_words)
        rows.extend(map(row, packer.close()))
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(frugal(run, 1 << 20 if lean else None), f"doc_id {kind.simpleString()}, " + _DDL + (", ids binary" if emit_ids else ""))


def _slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``size`` bytes of text together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), emit_ids=False)


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
