"""Table functions of SQL whose columns follow their arguments.

* ``whole_documents(TABLE(parts) PARTITION BY path ORDER BY part, columns => 'path, text, size')`` joins the parts of each file (path,
  content) back and extracts it: a row a file. ``columns`` names what comes out, each once: what extraction finds (``FOUND``), or any other column of
  the table with its own type, from the file's first part. Nothing named: all that is found.
* ``delimited(content, columns => 'id bigint, name string')``, for ``LATERAL``: the records of delimited text, typed. A column is found
  by its name in the header; ``header => false``: by place.

A file's parts are one group: a task holds ``max_bytes`` of one at most (256 MB by default), and a larger file is a row with an error. An unknown or
repeated name is an error of the query's analysis.

Defined cases: a null part of a file counts as empty, a file of null parts alone is the error row 'no content'; a null path is a group like others; null content
has no records. An empty field is null, also of strings; one that does not fit its type is null; records may
have fewer or more fields than the header (null; left out); a name that the header lacks is null in all records; blank lines are none.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyspark.sql.types as T
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textloom.functions import filetypes
from textloom.operators.registry import Registry

#: What extraction finds in a file, with its type.
FOUND = {"file_type": T.IntegerType(), "method": T.StringType(), "text": T.StringType(), "size": T.LongType(), "parts": T.LongType(), "error": T.StringType()}
MAX_BYTES = 256 << 20


def _constant(argument: AnalyzeArgument | None, name: str, default):
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _columns(table: T.StructType, wanted: str | None) -> T.StructType:
    names = [n.strip() for n in wanted.split(",")] if wanted else list(FOUND)
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a column is named twice")
    out = T.StructType()
    for name in names:
        if name in FOUND:
            out.add(name, FOUND[name])
        elif name in table.fieldNames() and name != "content":
            out.add(name, table[name].dataType)
        else:
            raise ValueError(f"no column {name}")
    return out


def _whole(own: Registry):
    class WholeDocuments:
        @staticmethod
        def analyze(files: AnalyzeArgument, columns: AnalyzeArgument | None = None, max_bytes: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not files.isTable or not {"path", "content"} <= set(files.dataType.fieldNames()):
                raise ValueError("whole_documents needs a table with path and content")
            if int(_constant(max_bytes, "max_bytes", MAX_BYTES)) < 0:
                raise ValueError("max_bytes must not be negative")
            return AnalyzeResult(schema=_columns(files.dataType, _constant(columns, "columns", None)))

        def __init__(self):
            self.first, self.held, self.size, self.parts, self.empty = None, [], 0, 0, True

        def eval(self, files: T.Row, columns: str | None = None, max_bytes: int = MAX_BYTES) -> None:
            if self.first is None:
                self.first, self.wanted, self.most = files.asDict(), columns, max_bytes
                self.first.pop("content")
            self.parts += 1
            if (data := files["content"]) is not None:
                self.empty = False
                self.size += len(data)
                if self.size <= self.most:
                    self.held.append(bytes(data))
                else:
                    self.held.clear()

        def terminate(self) -> Iterator[tuple]:
            if self.first is None:
                return
            path = self.first["path"] or ""
            code = filetypes.detect(path)
            found = {"file_type": code, "method": filetypes.EXTRACTORS.get(code, "raw"), "text": "", "size": 0, "parts": self.parts, "error": None}
            if self.empty:
                found["error"] = "no content"
            elif self.size > self.most:
                found["error"] = f"more than {self.most} bytes"
            else:
                r = own.safely(code, b"".join(self.held), path)
                text = r.text.encode("utf-8", "replace")
                found |= {"method": r.method, "text": text.decode(), "size": len(text), "error": r.error}
            names = [n.strip() for n in self.wanted.split(",")] if self.wanted else list(FOUND)
            yield tuple(found[n] if n in FOUND else self.first[n] for n in names)

    return WholeDocuments


def _bool(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip().lower())


def _whole_number(bits: int):
    def read(text: str) -> int | None:
        try:
            n = int(text)
        except ValueError:
            return None
        return n if -(1 << bits - 1) <= n < 1 << bits - 1 else None

    return read


def _double(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


#: Types that delimited text is read as, and how.
_READERS = {"string": (T.StringType(), str), "boolean": (T.BooleanType(), _bool), "int": (T.IntegerType(), _whole_number(32)), "bigint": (T.LongType(), _whole_number(64)), "double": (T.DoubleType(), _double)}


@dataclass
class _Typed(AnalyzeResult):
    """The columns that delimited text is read as, for the workers."""

    fields: list[tuple[str, str]] = field(default_factory=list)


def _typed(columns: str) -> _Typed:
    fields = [tuple(c.split()) for c in columns.split(",")]
    if any(len(f) != 2 or f[1].lower() not in _READERS for f in fields) or len({f[0].lower() for f in fields}) < len(fields):
        raise ValueError(f"columns must be different names, each with one of the types {', '.join(_READERS)}")
    types = [_READERS[kind.lower()][0] for _, kind in fields]
    return _Typed(schema=T.StructType([T.StructField(name, t) for (name, _), t in zip(fields, types, strict=True)]), fields=fields)


class Delimited:
    @staticmethod
    def analyze(content: AnalyzeArgument, columns: AnalyzeArgument, separator: AnalyzeArgument | None = None, header: AnalyzeArgument | None = None) -> AnalyzeResult:
        if content.isTable or content.dataType.typeName() not in ("string", "binary", "void"):
            raise ValueError("content must be text or bytes")
        if len(_constant(separator, "separator", ",")) != 1:
            raise ValueError("separator must be one character")
        _constant(header, "header", True)
        return _typed(_constant(columns, "columns", ""))

    def __init__(self, typed: _Typed):
        self.fields = [(name, _READERS[kind.lower()][1]) for name, kind in typed.fields]

    def eval(self, content: str | bytes | None, columns: str, separator: str = ",", header: bool = True) -> Iterator[tuple]:
        if content is None:
            return
        text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
        csv.field_size_limit(max(len(text) + 1, 1 << 17))
        records = (r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=separator) if r)
        names = next(records, []) if header else [n for n, _ in self.fields]
        readers = [(names.index(n) if n in names else len(names), read) for n, read in self.fields]
        for r in records:
            yield tuple(read(r[i]) if i < min(len(r), len(names)) and r[i] != "" else None for i, read in readers)


def register(spark: SparkSession, registry: Registry | None = None) -> None:
    spark.udtf.register("whole_documents", F.udtf(_whole(registry or Registry())))
    spark.udtf.register("delimited", F.udtf(Delimited))
