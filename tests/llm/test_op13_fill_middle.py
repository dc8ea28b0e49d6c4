import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import op13_fill_middle as op

UNITS = {"char": r"(?s:.)", "word": r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+", "line": r"[^\n]*\n|[^\n]+"}


def brute(key, text, unit="char", seed="1"):
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = re.findall(UNITS[unit], text)
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n\té日🙂<>PSM") for _ in range(rng.choice([0, 1, 2, 5, 70, 900]))) for _ in range(400)]
    texts += ["<P>", "a<S>b", "x<M", "<", "<<P", "\n\n", "  ", " a", "🙂", "x" * 300_000 + "é" * 100_000, None]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 1), (5, "again", 2), (5, "again", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, output int").repartition(3)


@pytest.mark.parametrize("unit", UNITS)
def test_equals_cutting_by_lists(docs, unit):
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in op.transform(docs, unit=unit).collect()]
    assert sorted(got, key=repr) == sorted((brute(r.doc_id, r.text or "", unit) for r in docs.collect()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_round_trip_and_parameters(docs):
    for settings in ({}, {"rate": 100, "suffix_first": 100, "seed": "2"}, {"rate": 0}):
        out = op.transform(docs, **settings).select("doc_id", op.restored(F.col("output"), F.col("form")).alias("text"), "form")
        rows = out.collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        if settings:
            assert {r.form for r in rows} - {"plain"} == ({"spm"} if settings["rate"] else set())
    assert op.transform(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        op.transform(docs, unit="page")


def test_ranked_bits():
    rng = random.Random(1)
    for size in (1, 63, 64, 65, 200, 1000, 5000):
        bits = rng.getrandbits(size) | 1 << (size - 1)
        places = [i for i in range(size) if bits >> i & 1]
        assert [op.ranked_bit(bits, k, size) for k in range(len(places))] == places


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 7L AS doc_id, cast(unhex('ff8061e9') AS string) AS text UNION ALL SELECT 8L, cast(unhex('80') AS string)")
    out = op.transform(df, rate=100).select("doc_id", F.hex(op.restored(F.col("output"), F.col("form")).cast("binary")).alias("b"))
    assert {(r.doc_id, r.b.replace("EFBFBD", "")) for r in out.collect()} <= {(7, "61"), (8, ""), (7, "FF8061E9"), (8, "80")}
    assert op.unit_ends(b"\x80\xff\x80a") == 0b1101


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(op.ORACLES["op13_fill_middle"])
    got = op.op13_fill_middle(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
