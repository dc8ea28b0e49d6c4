import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textloom.plans import tablefunctions

PARTS = [("a.txt", 1, b"\xa4!", 7), ("a.txt", 0, b"one \xc3", 7), ("b.html", 0, b"<p>x&am", 8), ("b.html", 1, b"p;y", 8), ("none.txt", 0, None, 9), ("c.docx", 0, b"no", 1), ("half.txt", 0, None, 2), ("half.txt", 1, b"h", 3), (None, 0, b"raw", 4)]


@pytest.fixture(scope="module")
def parts(spark):
    tablefunctions.register(spark)
    rows = spark.createDataFrame(PARTS, "path string, part int, content binary, owner int")
    rows.withColumn("text", F.lit("clash")).createOrReplaceTempView("parts")
    return rows


def _whole(spark, more=""):
    return spark.sql(f"SELECT * FROM whole_documents(TABLE(SELECT * FROM parts) PARTITION BY path ORDER BY part{more})")


def test_columns_follow_the_argument(spark, parts):
    got = _whole(spark, ", columns => 'owner, path, text, parts'")
    assert got.schema.simpleString() == "struct<owner:int,path:string,text:string,parts:bigint>"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(7, "a.txt", "one ä!", 2), (8, "b.html", "x&y", 2), (9, "none.txt", "", 1), (1, "c.docx", "", 1), (2, "half.txt", "h", 2), (4, None, "raw", 1)], key=repr)


def test_all_that_is_found_and_errors(spark, parts):
    got = _whole(spark)
    assert got.columns == list(tablefunctions.FOUND)
    errors = {r.error for r in got.collect()}
    assert {None, "no content"} < errors and len(errors) == 3  # and what is wrong with the docx
    small = {r.path: r.error for r in _whole(spark, ", columns => 'path, error', max_bytes => 6").collect()}
    assert small["a.txt"] == "more than 6 bytes" and small["half.txt"] is None
    assert spark.sql("SELECT * FROM whole_documents(TABLE(SELECT * FROM parts WHERE part > 9) PARTITION BY path)").count() == 0


@pytest.mark.parametrize("columns", ["nothing", "text, TEXT", "content"])
def test_names_that_cannot_be(spark, parts, columns):
    with pytest.raises(AnalysisException):
        _whole(spark, f", columns => '{columns}'")


def test_delimited(spark, parts):
    text = "﻿name,id,id\r\n\"a, \"\"b\"\"\nc\",1,9\r\n\r\nx,99999999999\n,no,3,4\ny\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "id\n5")], "k int, content string")
    sql = "SELECT k, d.* FROM {rows}, LATERAL delimited(content, columns => 'id int, name string, gone double') d"
    got = spark.sql(sql, rows=rows)
    assert got.schema.simpleString() == "struct<k:int,id:int,name:string,gone:double>"
    want = [(1, 1, 'a, "b"\nc', None), (1, None, None, None), (1, None, "x", None), (1, None, "y", None), (4, 5, None, None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    placed = spark.sql("SELECT d.* FROM VALUES (encode('true\t2.5\t1', 'utf-8')) t(c), LATERAL delimited(c, columns => 'a boolean, b double', separator => '\t', header => false) d")
    assert [tuple(r) for r in placed.collect()] == [(True, 2.5)]
    for bad in ("'id'", "'id date'", "'id int, ID int'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT d.* FROM {{rows}}, LATERAL delimited(content, columns => {bad}) d", rows=rows)
