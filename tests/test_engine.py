import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.__main__ import main
from textloom.operators.registry import Registry
from textloom.operators.result import Result
from textloom.plans import packers
from textloom.plans import queries as base
from textloom.plans.extract import archive_entries, extract_documents, register
from textloom.sources import files
from textloom.streaming.incremental import extract_stream

ROWS = [("a/x.html", b"<p>one<p>two"), ("b.txt", b"caf\xc3\xa9"), ("c.bin", b"\xff"), ("d.docx", b"broken"), ("e.zip", packers.zipped({"i.md": b"# h", "j/k.txt": b"t"})), ("f.vsd", b"v\x01s"), ("g.pdf", None), ("h.json", b"{}"), (None, b"raw")]


def by_path(rows):
    return {r.path: r for r in rows}


def test_extract_documents(spark):
    got = by_path(extract_documents(spark.createDataFrame(ROWS, "path string, content binary").repartition(3)).collect())
    assert len(got) == len(ROWS)
    assert [(got[p].text, got[p].method) for p in ("a/x.html", "b.txt", "f.vsd", "h.json")] == [("one two", "html"), ("café", "text"), ("vs", "vsd"), ("{}", "text")]
    assert got["c.bin"].text == "�" and got["d.docx"].error and got["d.docx"].text == "" and got["g.pdf"].error == "no content"
    assert got["e.zip"].n_parts == 2 and got["b.txt"].size == 5 and got["e.zip"]["class"] == "archive" and got[None].text == "raw"


def test_vsd_beyond_a_mebibyte_keeps_its_tail(spark, tmp_path):
    body = b"ab\x00\xe9\r\n" * 300_000 + b"tail"
    want = "ab\r\n" * 300_000 + "tail"
    rows = [("a.vsd", body), ("b.zip", packers.zipped({"c.vsd": body}))]
    got = by_path(extract_documents(spark.createDataFrame(rows, "path string, content binary")).collect())
    assert got["a.vsd"].text == want and got["b.zip"].text.rstrip("\n").endswith("tail") and got["b.zip"].text.count("ab\r\n") == 300_000
    assert Registry().extract(202, body).text == want
    docs = spark.createDataFrame([(1, "aé\x01\n" * 500_000 + "end"), (2, "short"), (3, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("printable_ascii_vsd", "vsd_text"):
        sql = con.sql(base.ORACLES[name])
        assert sorted(map(tuple, base.QUERIES[name](spark, str(tmp_path)).select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_override_and_own_extractor(spark):
    df = spark.createDataFrame([("x.bin", b"<p>a</p>")], "path string, content binary")
    assert extract_documents(df, file_type=1).first().text == "a"
    own = Registry()
    own.register(114, lambda data, name: Result(name.upper(), "own"), override=True)
    own.register(2, lambda data, name: Result("mine", "own"), override=True)
    assert extract_documents(df, registry=own).first().text == "X.BIN"
    assert extract_documents(df, file_type=2, registry=own).first().text == "mine"


def test_archive_rows_and_sql(spark):
    df = spark.createDataFrame(ROWS, "path string, content binary")
    rows = archive_entries(df.where("path = 'e.zip'")).collect()
    assert [(r.entry_path, r.depth, r.text) for r in rows] == [(["i.md"], 1, "h"), (["j/k.txt"], 1, "t")]
    assert archive_entries(df.where("path = 'b.txt'")).first().error
    register(spark)
    df.createOrReplaceTempView("files_seen")
    got = spark.sql("SELECT path, e.entry_path, e.text FROM files_seen, LATERAL archive_entries(path, content) e WHERE path = 'e.zip' ORDER BY 2").collect()
    assert [r.entry_path for r in got] == ["i.md", "j/k.txt"]
    assert spark.sql("SELECT extract_text(1, content, path) AS t FROM files_seen WHERE path = 'a/x.html'").first().t == "one two"


@pytest.fixture
def folder(tmp_path):
    for path, data in ROWS:
        if path and data is not None:
            (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / path).write_bytes(data)
    return tmp_path


def test_scan_census_and_write(spark, folder):
    found = files.scan(spark, f"{folder}/in")
    counts = {r.file_type: (r.files, r.bytes) for r in files.census(found).collect()}
    assert counts[1] == (1, 12) and sum(n for n, _ in counts.values()) == 7
    assert files.scan(spark, f"{folder}/in", suffixes=["txt", "json"]).count() == 2
    names = [r.path.rpartition("/in/")[2] for r in files.in_walk_order(found).select("path").collect()]
    assert names[0] == "a/x.html" and names == sorted(names, key=lambda n: n.split("/"))
    files.write(extract_documents(files.spread(found, 3)), f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").where("class = 'text'").count() == 3
    plan = files.census(found)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "Python" not in plan


def test_stream_reads_each_file_once(spark, folder):
    for n in (7, 8):
        extract_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp").awaitTermination()
        assert spark.read.parquet(f"{folder}/out").count() == n
        (folder / "in" / "new.txt").write_bytes(b"new")
    assert spark.read.parquet(f"{folder}/out").where(F.col("text") == "new").count() == 1


def test_command_line(folder, capsys):
    assert main(["-i", f"{folder}/in/b.txt"]) == 0
    assert capsys.readouterr().out == f"file[{folder}/in/b.txt], size[5]\n"
    assert main(["-i", f"{folder}/in/a/x.html", "-v"]) == 0 and "one two" in capsys.readouterr().out
    assert main(["-i", f"{folder}/in/d.docx"]) == 1 and main(["-i", f"{folder}/none"]) == 1
    assert main(["-i", f"{folder}/in/b.txt", "-t", "114"]) == 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_queries_equal_their_sql(spark, duck, sf_dir, name):
    got, want = base.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(base.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(base.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("functions", "operators", "plans", "sources", "streaming"):
        for name in os.listdir(f"{root}/textloom/{part}"):
            if name.endswith(".py"):
                with open(f"{root}/textloom/{part}/{name}") as f:
                    assert "textloom.llm" not in f.read()
    code = f"""
import shutil, sys
shutil.copytree({root!r} + "/textloom", {str(tmp_path)!r} + "/textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
shutil.copy({root!r} + "/__spark_entry__.py", {str(tmp_path)!r})
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
assert len(e.queries()) > 40 and "pipeline" not in e.queries() and len(e.oracle_sql()) > 40
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
