import random

from pyspark.sql import functions as F

from textloom.plans.queries import QUERIES
from textloom.plans.extract import extract_documents
from textloom.plans.layout import text_lines
from textloom.sources import files

SCHEMA = "d string, page int, x double, y double, width double, height double, text string, line int"


def laid(spark, rows, **settings):
    found = text_lines(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3), "d", **settings).orderBy("d", "page", "line").collect()
    return [(r.d, r.page, r.line, r.text) for r in found]


def test_lines_words_and_columns(spark):
    rows = [
        ("a", 1, 10.0, 700.0, 12.0, 10.0, "He"), ("a", 1, 22.5, 700.2, 18.0, 10.0, "llo"), ("a", 1, 45.0, 699.9, 30.0, 10.0, "world"), ("a", 1, 200.0, 700.0, 30.0, 10.0, "right"),
        ("a", 1, 10.0, 688.0, 30.0, 10.0, "next"), ("a", 2, 10.0, 700.0, 30.0, 10.0, "page"), ("b", 1, 0.0, 0.0, None, None, "x"), ("b", 1, 0.0, 0.0, None, None, "x"), ("b", 1, 5.0, None, 1.0, 1.0, "lost"),
        ("b", 1, 1.0, 0.0, 1.0, 1.0, None), ("b", 1, 1.0, 0.0, 1.0, 1.0, ""), (None, None, 1.0, 5.0, 3.0, 4.0, "n"),
    ]
    want = [(None, None, 1, "n"), ("a", 1, 1, "Hello world\tright"), ("a", 1, 2, "next"), ("a", 2, 1, "page"), ("b", 1, 1, "xx")]
    assert laid(spark, rows) == want
    random.Random(1).shuffle(rows)
    assert laid(spark, rows) == want
    assert laid(spark, rows[:0]) == []
    assert ("a", 1, 1, "Hello world right") in laid(spark, rows, column_gap=50.0)


def test_observed_metrics_equal_what_was_written(spark, tmp_path):
    rows = [("a.txt", b"text"), ("b.html", b"<p>\xc3\xa9"), ("c.docx", b"broken"), ("d.zip", b"broken"), ("e.gif", b"\xff\xfe"), ("f.pdf", None), (None, b"raw"), ("g.csv", b"")]
    seen = files.write(extract_documents(spark.createDataFrame(rows, "path string, content binary").repartition(3)), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    for suffix, some in {"": back, **{f"_{c}": back.where(F.col("class") == c) for c in ("text", "document", "archive", "image", "other")}}.items():
        n, size, errors = some.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count("error")).first()
        assert (seen[f"files{suffix}"], seen[f"bytes{suffix}"], seen[f"errors{suffix}"]) == (n, size, errors)
    assert seen["files"] == len(rows) and seen["errors"] == 3


def test_positioned_lines_has_one_exchange_of_words(spark, sf_dir):
    plan = QUERIES["positioned_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_positioned_lines_deals_pages_not_words(spark, sf_dir):
    """Words come into being behind the exchange, in parts whose number follows the size of the texts, and are sorted only where windows need it."""
    plan = QUERIES["positioned_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning")
    assert "Generate inline" in above and "Generate inline" not in below and plan.count("Sort [") == 2 and "REPARTITION_BY_NUM" in below, plan
