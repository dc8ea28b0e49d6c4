import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import op2_fingerprints as op


def ordered(rows):
    rows = [(k, t or "") for k, t in rows]
    return sorted([r for r in rows if r[0] is not None], reverse=True) + sorted([r for r in rows if r[0] is None], key=lambda r: r[1], reverse=True)


def edit(t, u):
    k = len(t) // 3
    return t[: len(t) - k] + u[:k]


ROWS = [(i * i % 997, f"Line {i}, of x.\nNo {i % 7}! é\U0001f600{'y' * (i % 11)}\n") for i in range(90)] + [(None, "b. c"), (None, None), (5000, None), (5000, None), (5000, "z"), (5001, ""), (7, "a" * 3000 + ". " + "b " * 9000), (8, "same\n" * 20000)]


@pytest.mark.parametrize("bucket_rows", [1, 7, 30, 100000])
def test_next_documents(spark, bucket_rows):
    df = spark.createDataFrame([(k, t, 1) for k, t in ROWS], "doc_id long, text string, next_text int").repartition(3)
    got = [(r.doc_id, r.text, r.next_text) for r in op.neighbours(df, bucket_rows=bucket_rows).collect()]
    rows = ordered(ROWS)
    want = [(*r, rows[(i + 1) % len(rows)][1]) for i, r in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_of_a_few_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op2_fingerprints(spark, str(tmp_path)).collect()
    rows, prints = ordered(ROWS), {}
    want = sorted((k, len(t), hashlib.sha256(edit(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(rows) if k is not None)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want and len(got) == len(ROWS)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_id = {k: t for k, t in rows}
    for r in got:
        if r.doc_id not in (None, 5000):
            assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_prints_locate_edits(spark):
    rng = random.Random(2)
    lines = [f"p{i} a, b{rng.random()} c. d" for i in range(200)]
    other = list(lines)
    other[100] = "changed."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(op.fingerprint(op.tree(F.col("a"))).alias("a"), op.fingerprint(op.tree(F.col("b"))).alias("b"))
    r = df.select("a", "b", op.differing(F.col("a"), F.col("b")).alias("d"), op.differing(F.col("a"), F.col("a")).alias("none"), op.likeness(op.leaves_of(F.col("a")), op.leaves_of(F.col("b"))).alias("near")).first()
    assert r.none == [] and 1 <= len(r.d) <= 2 and 0.98 < r.near < 1
    sections = r.a.split(":")[1].split("|")
    before = sum(s.count(" ") + 1 for s in sections[: r.d[0]])
    assert before <= 100 <= before + sum(sections[i].count(" ") + 1 for i in r.d)


def test_shown_leaves_give_the_same_likeness(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    two = df.select(op.tree(F.col("text")).alias("t")).select(op.leaves(F.col("t")).alias("a"), op.leaves_of(op.fingerprint(F.col("t"))).alias("b"))
    assert two.where("a != b").count() == 0


def test_empty_table_and_no_python(spark, sf_dir):
    assert op.neighbours(spark.createDataFrame([], "doc_id long, text string"), {"tree": op.tree}).count() == 0
    plan = op.op2_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
