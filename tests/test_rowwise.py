import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.plans import rowwise
from textloom.plans.extract import archive_entries, extract_text
from textloom.plans.packers import tar


def test_results_leave_in_small_batches_and_in_order(spark):
    batches = iter([(pa.array(range(100)), pa.array(["x"] * 100)), (pa.array([], pa.int64()), pa.array([], pa.string())), (pa.array([None]), pa.array(["y"]))])
    f = rowwise.function(lambda n, t: None if n is None else t * 1_000_000 + str(n), "string", pa.string())
    out = list(f.func(batches))
    assert max(x.nbytes for x in out) <= rowwise.CHUNK + 1_100_000 and len(out) > 20
    assert [v[1_000_000:] if v else v for x in out for v in x.to_pylist()] == [*map(str, range(100)), None]


def test_a_batch_is_let_go_before_the_next_comes(spark):
    pool, before, seen = pa.default_memory_pool(), pa.total_allocated_bytes(), []

    def batches():
        for _ in range(4):
            yield pa.array([b"x" * 1000] * 10_000)
            seen.append(pool.bytes_allocated() - before)

    for _ in rowwise.function(lambda b: len(b), "bigint", pa.int64()).func(batches()):
        pass
    assert max(seen) < 12_000_000


def test_rows_of_a_table_leave_in_small_batches():
    schema = pa.schema([("n", pa.int64()), ("t", pa.string())])
    out = list(rowwise.table(lambda n: ((i, "x" * 100_000) for i in range(n)), schema)(iter([pa.record_batch([pa.array([0, 200, 3])], ["n"]), pa.record_batch([pa.array([0])], ["n"])])))
    assert max(b.nbytes for b in out) <= rowwise.CHUNK + 200_000 and [v for b in out for v in b.column(0).to_pylist()] == [*range(200), *range(3)]


@pytest.mark.parametrize("rows", [1, 7])
def test_batches_of_any_length_give_the_same(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df = spark.range(20, numPartitions=2).select("id", F.when(F.col("id") % 5 != 0, F.lit(tar({"a": b"1", "b": b"2"}))).alias("content"))
        got = {r.id: r.r for r in df.select("id", extract_text(F.lit(18), F.col("content"), F.lit("f.tar")).alias("r")).collect()}
        assert {i: r.n_parts for i, r in got.items()} == {i: 2 if i % 5 else None for i in range(20)}
        assert archive_entries(df.select(F.concat("id", F.lit(".tar")).alias("path"), "content")).where("depth = 1").count() == 32
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
