import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import op6_packing as op


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(op.tokenizer_file())


@pytest.mark.parametrize("text", ["", "  ", "It's we'll THE cat.,) x.", "a\n\nb\t c d e", "ΣΑΣ, İstanbul. é ́x", "<|endoftext|> x<|startoftext|>.", "12.5, 3.", "日本語。 ñ. ſ.", "a\x1cb\x0bc", "x" * 5000, "'s 't. don't, '.", "...,,, a.. b,. c., ½. ²,"])
def test_ids_equal_the_tokenizers(tokenizer, text):
    got = np.frombuffer(op.WordTokenizer(op.tokenizer_file()).encode([text])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts(tokenizer):
    rng, signs = random.Random(3), "abAB .,'\n\t-1é½́)ſ<|>"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(800)]
    got = op.WordTokenizer(op.tokenizer_file()).encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def check_whole(rows, docs, tokenizer, padded_most):
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for k, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padded += at & (at - 1) != 0
    assert padded <= padded_most


def test_pieces_rebuild_every_document(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_whole(op.op6_packing(spark, sf_dir).collect(), docs, tokenizer, 0)


def test_long_empty_null_and_clashing(spark, tokenizer):
    docs = {1: None, 2: "", 3: "word " * 30000, 4: "a b", 5: "a b"}
    df = spark.createDataFrame([(k, t, 9) for k, t in docs.items()], "doc_id long, text string, ids int").coalesce(1)
    rows = op.pack(df, op.tokenizer_file(), buffer_tokens=100)
    check_whole(rows.collect(), docs, tokenizer, 0)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows.collect())


def test_other_tokenizers_encode_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert op.WordTokenizer.knows(op.tokenizer_file()) and not op.WordTokenizer.knows(path)
    docs = {"a": None, "b": "It's  a\n\ntext, with 12 Words.", "c": "Ünïcode 漢字 " * 700}
    rows = op.pack(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), path)
    assert rows.schema["doc_id"].dataType.simpleString() == "string"
    check_whole(rows.collect(), docs, Tokenizer.from_file(path), 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.pack(df, op.tokenizer_file()).count() == 0


def test_step_groups_are_equal(spark, sf_dir):
    rows = op.pack(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), op.tokenizer_file(), emit_ids=False, group_tokens=8192).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.tier, r.step_group] += r.length
    for tier in {t for t, _ in tokens}:
        short = [v for (t, _), v in tokens.items() if t == tier and v != 8192]
        assert tier < 256 or len(short) <= 1
