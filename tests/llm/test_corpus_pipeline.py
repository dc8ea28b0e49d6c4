import zlib

import pytest
from tokenizers import Tokenizer

from textloom.llm import op3_line_dedup, op4_toxicity, op6_packing, op7_decontamination, op10_jaccard_join
from textloom.llm.common import stored

import corpus_pipeline

from .test_op3_line_dedup import brute as lines_brute
from .test_op6_packing import check_whole
from .test_op10_jaccard_join import brute as classes_brute


def test_settings_stay_as_they_are(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() and spark.conf.get(name) == before and rows.sparkSession.conf.get(name) == before


def test_every_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = op4_toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stored(stage(spark, docs, sf), "test")
        after = out.collect()
        if name == "packing":
            check_whole(after, {r.doc_id: r.text for r in before}, Tokenizer.from_file(op6_packing.tokenizer_file()), 0)
            assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in after)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            assert ids == sorted(r.doc_id for r in before if model.judge(r.text.encode())[0] < 0.5)
        elif name == "line_dedup":
            assert sorted((r.doc_id, r.text) for r in after) == sorted((k, t) for k, _, _, t in lines_brute([(r.doc_id, r.text, r.source) for r in before]))
        elif name == "near_duplicates":
            assert ids == sorted(k for k, _, c in classes_brute([(r.doc_id, r.text) for r in before]) if k == c)
        else:
            assert ids == sorted(k for k, v in op7_decontamination.brute_force({r.doc_id: r.text for r in before}, items).items() if not v[4])
        docs = out


def test_stage_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "a", 0)]])
def test_empty_and_null_rows(spark, rows, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "test")
        assert docs.count() == len(rows)
