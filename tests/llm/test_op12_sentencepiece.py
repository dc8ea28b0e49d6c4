import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from textloom.llm import op12_sentencepiece as op

ODD = ["", " ", "  ", "▁", "▁▁ ", " a", "a ", "a  b", "a▁b ▁ c", "\n\n x\t y", "x" * 5000, " " * 4000, "<s> </s> <unk> <0x0A>", "\x00 \x01", "é́ ﬁ Ａ １２", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", " a　b", "1234567 89.5%", "�", "a" * 300 + " b" * 300]


@pytest.fixture(scope="module")
def processor():
    return SentencePieceProcessor(model_proto=op.model_bytes())


def test_whole_documents_equal_the_library(spark, sf_dir, processor):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op.op12_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = processor.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_odd_texts(spark, processor):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" ▁\nabcé日🙂the.,09​") for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame([(str(i), t, 0) for i, t in enumerate(texts)] + [("null", None, 0), (None, "x y", 0), ("0", "", 0)], "doc_id string, text string, ids int").repartition(3)
    model = op.model_bytes()
    for most in (op.TABLE_BYTES, 0):
        rows = op.decode(op.encode(docs, model, table_bytes=most), model).collect()
        assert len(rows) == len(texts) + 3
        for r in rows:
            text = "x y" if r.doc_id is None else "" if r.doc_id == "null" else texts[int(r.doc_id)]
            assert r.ids == processor.encode(text, add_eos=True)
            assert r.text == processor.decode(r.ids)
    assert op.encode(docs.limit(0), model).collect() == []
    nothing = docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)
    assert [r.text for r in op.decode(nothing, model).collect()] == [""]


def test_each_distinct_chunk_is_segmented_once(processor):
    table = op.ChunkTable(op.model_bytes(), True)
    asked = []
    plain = table._segmented
    table._segmented = lambda new: (asked.extend(new), plain(new))[1]
    texts = ["one two one", "two  one", "one"]
    got = table.encode(texts) + table.encode(texts)
    assert sorted(asked) == sorted({" one", " two", "  one"})
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == processor.encode(texts) * 2


def test_table_is_bounded():
    table = op.ChunkTable(op.model_bytes(), True, most=20_000)
    sizes = []
    for i in range(60):
        table.encode([" ".join(f"w{i}x{k}" for k in range(50)), "z" * 100_000])
        sizes.append(len(table.known))
        assert not any(len(x) > op.LONG for x in table.known)
    assert max(sizes) < 300


def test_models_of_another_kind_take_whole_texts(processor):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = op.model_bytes()
    assert op.by_chunk(model)
    spec = pb.ModelProto()
    spec.ParseFromString(model)
    piece = spec.pieces[5000]
    piece.piece = "ab▁cd"
    assert not op.by_chunk(spec.SerializeToString())
    spec.ParseFromString(model)
    spec.normalizer_spec.remove_extra_whitespaces = True
    other = spec.SerializeToString()
    assert not op.by_chunk(other)
    got = op.ChunkTable(other, False).encode(["a  b ", ""])
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == SentencePieceProcessor(model_proto=other).encode(["a  b ", ""])
