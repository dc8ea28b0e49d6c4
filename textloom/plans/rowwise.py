"""Functions of one row that hold little: a batch that Spark sends is read in place, a row at a time, and results leave in small batches.

So a Python worker holds one batch (``spark.sql.execution.arrow.maxBytesPerBatch`` or one row), one row as objects and
``CHUNK`` bytes of results, however long a partition is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes of results after which a batch leaves.
CHUNK = 4 << 20


def weight(value) -> int:
    """About the bytes of a result."""
    if isinstance(value, dict):
        return sum(map(weight, value.values()))
    if isinstance(value, (list, tuple)):
        return sum(map(weight, value))
    return 64 + (len(value) if isinstance(value, (str, bytes)) else 0)


def values(columns: list[pa.Array]) -> Iterator[tuple]:
    """Rows as Python values, made one at a time."""
    for i in range(len(columns[0])):
        yield tuple(c[i].as_py() for c in columns)


def function(f: Callable, ddl: str, kind: pa.DataType):
    """A function of columns that gives ``f`` of the values of each row."""

    @F.arrow_udf(ddl)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held = [], 0
            for row in values(list(batch) if isinstance(batch, tuple) else [batch]):
                out.append(f(*row))
                held += weight(out[-1])
                if held >= CHUNK:
                    yield pa.array(out, kind)
                    out, held = [], 0
            yield pa.array(out, kind)
            # so that two batches are never held at once
            batch = row = None

    return run


def table(f: Callable[..., Iterator[tuple]], schema: pa.Schema):
    """For ``mapInArrow``: the rows that ``f`` gives for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in values(batch.columns):
                for one in f(*row):
                    rows.append(one)
                    held += weight(one)
                    if held >= CHUNK:
                        yield _batch(rows, schema)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, schema)
            batch = row = rows = None

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
