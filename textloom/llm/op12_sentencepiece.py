"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model has its white space mark after another letter, merges never join over the border of a chunk: marks in a row
and the letters up to the next mark. So a text's ids are its chunks' ids in a row. Each worker keeps a table of chunk and ids; of the
texts at hand only chunks that the table lacks are segmented, each once, by the model, and all ids are joined back by
position. The driver reads from the model whether it is of that kind (byte pair merges, text taken as it is, a mark put in
front); whole texts of any other model are segmented, with equal results and more time.

The model's bytes are part of the task (half a MB, fixed), so executors need no file. There is no shuffle.

Defined cases: a null or empty text is the end id alone; bytes that are no UTF-8 count as U+FFFD, as for the library; repeated rows
are encoded each; ids of any type are passed on; extra columns are ignored; an empty table gives an empty result. A table
holds ``TABLE_BYTES`` of chunks and ids; a fuller one is begun anew, and a chunk of over ``LONG`` letters is not kept, so memory is
bounded by the table and one text. Null ids decode to the empty text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bytes_of, frugal, table
from .op6_packing import _slices

MARK = "▁"
#: Bytes of chunks and ids in a worker's table; what an entry costs besides; letters of a chunk that is not kept.
TABLE_BYTES, ENTRY_BYTES, LONG = 128 << 20, 160, 256
#: Text, or ids, that are worked on together.
SLICE_BYTES = 2 << 20
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def by_chunk(model: bytes) -> bool:
    """Whether a model's pieces stay within chunks, and its text is taken as it is but for marks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    rule, train = spec.normalizer_spec, spec.trainer_spec
    as_it_is = not rule.precompiled_charsmap and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces
    plain = not train.treat_whitespace_as_suffix and train.model_type == pb.TrainerSpec.BPE
    own = pb.ModelProto.SentencePiece.USER_DEFINED
    return as_it_is and plain and all(x.type != own and (MARK not in x.piece.lstrip(MARK)) for x in spec.pieces)


class ChunkTable:
    """Ids of chunks that were seen, as little-endian signed 32-bit numbers."""

    def __init__(self, model: bytes, chunks: bool, most: int = TABLE_BYTES):
        from sentencepiece import SentencePieceProcessor

        self.processor, self.chunks, self.most = SentencePieceProcessor(model_proto=model), chunks, most
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _segmented(self, new: list[str]) -> list[bytes]:
        # the model puts a mark in front of what is not empty: it stands for the chunk's first
        ids = self.processor.encode([x[1:] for x in new], num_threads=1)
        return [np.array(i if x[1:] else [self.processor.piece_to_id(MARK)], "<i4").tobytes() for i, x in zip(ids, new, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        if not self.chunks:
            return [np.array(i, "<i4").tobytes() for i in self.processor.encode(texts, num_threads=1)]
        # a raw mark is a space to the model
        parts = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if self.size > self.most:
            self.known, self.size = {}, 0
        known = self.known
        new = list(set().union(*parts).difference(known))
        table_ = dict(zip(new, self._segmented(new), strict=True))
        long = {x: table_.pop(x) for x in new if len(x) > LONG}
        known.update(table_)
        self.size += sum(len(x) + len(y) + ENTRY_BYTES for x, y in table_.items())
        find = (lambda x: known.get(x) or long[x]) if long else known.__getitem__
        return [b"".join(map(find, p)) for p in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids)


_tables: dict[int, ChunkTable] = {}


def _worker_table(model: bytes, chunks: bool, most: int) -> ChunkTable:
    """A table for each worker process and model, so that later tasks find the chunks of earlier ones."""
    key = zlib.crc32(model)
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(model, chunks, most)
    return _tables[key]


def _lists(raws: Iterable[bytes]) -> pa.Array:
    raws = list(raws)
    ends = np.cumsum([0, *(len(r) // 4 for r in raws)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def encode(docs: DataFrame, model: bytes, end_id: int | None = 2, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id and ids (array of int) of each text, with ``end_id`` at the end if there is one."""
    kind, chunks = docs.schema["doc_id"].dataType, by_chunk(model)
    end = b"" if end_id is None else np.array([end_id], "<i4").tobytes()
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            known = _worker_table(model, chunks, table_bytes)
            for some in _slices(b, SLICE_BYTES):
                texts = [(t or b"").decode("utf-8", "replace") for t in bytes_of(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(schema.field(0).type), _lists(r + end for r in known.encode(texts))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids) and text, by the model's own decoding."""
    kind = encoded.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        for b in batches:
            known = _worker_table(model, False, 0)
            for some in _id_slices(b):
                lists = some.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column(0).cast(schema.field(0).type), some.column(1).cast(schema.field(1).type), pa.array(known.decode([x or [] for x in lists]), pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), f"doc_id {kind.simpleString()}, ids array<int>, text string")


def _id_slices(batch: pa.RecordBatch):
    """Rows of a batch with about ``SLICE_BYTES`` / 4 ids together, one row at least."""
    ends = batch.column(1).offsets.to_numpy()[1:].astype(np.int64) - batch.column(1).offsets[0].as_py()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES // 4, "right")))
        yield batch.slice(at, to - at)
        at = to


def model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    both = decode(encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
#: A tokenizer is not for SQL; tests hold ids and texts against the library's own over whole texts.
ORACLES: dict[str, str] = {}
