"""Documents to text: one row in, one row out, whatever the bytes are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import filetypes, textnorm
from textloom.operators import native
from textloom.operators.archive import BLOCK, KINDS, walk
from textloom.operators.registry import Registry
from textloom.operators.result import ExtractError

from . import rowwise

#: Types whose text is an expression: no Python runs for them.
NATIVE_TYPES = (1, 2, 4, 5, 202, *sorted({*filetypes.TYPES.values(), filetypes.UNKNOWN} - filetypes.EXTRACTORS.keys()))
_FOUND = "text string, method string, n_parts int, error string"
_FOUND_ARROW = pa.struct([("text", pa.string()), ("method", pa.string()), ("n_parts", pa.int32()), ("error", pa.string())])
_ENTRY = pa.schema([("path", pa.string()), ("entry_path", pa.list_(pa.string())), ("depth", pa.int32()), ("file_type", pa.int32()), ("text", pa.string()), ("size", pa.int64()), ("method", pa.string()), ("error", pa.string())])
_ENTRY_DDL = "path string, entry_path array<string>, depth int, file_type int, text string, size bigint, method string, error string"


def extract_text(file_type: Column, content: Column, path: Column, registry: Registry | None = None) -> Column:
    """Struct of text, method, n_parts and error, in Arrow batches."""
    own = registry or Registry()

    def extract(code: int, data: bytes | None, path: str | None) -> dict:
        if data is None:
            return dict.fromkeys(("text", "method", "n_parts", "error"))
        r = own.safely(code, data, path or "")
        return {"text": r.text.encode("utf-8", "replace").decode(), "method": r.method, "n_parts": max(1, len(r.parts)), "error": r.error}

    return rowwise.function(extract, _FOUND, _FOUND_ARROW)(file_type, content, path)


def extract_documents(files: DataFrame, file_type: int | None = None, registry: Registry | None = None, keep: tuple[str, ...] = (), with_bytes: bool = False) -> DataFrame:
    """The columns to ``keep`` and path, file_type, class, method, text, size, n_parts, error for each row of ``files`` (path, content).

    The type comes from the path unless ``file_type`` overrides it. ``with_bytes`` adds ``bytes``: for types that are passed on as they are
    (txt, csv, json and all without an extractor) the content unchanged, UTF-8 or not, and the bytes of the text for all
    others; ``size`` is then their length. Bytes of native types never reach a Python worker.
    There is no shuffle: a file is a row, and an archive is expanded within its row.
    """
    own = registry or Registry()
    code = F.lit(file_type).cast("int") if file_type else filetypes.detect_type(F.col("path"))
    rows = files.select(*keep, "path", "content", code.alias("file_type"))
    is_native = F.col("file_type").isin([t for t in NATIVE_TYPES if t not in own.own])
    plain = native.plain_text(F.col("content"))
    passed = is_native & ~F.col("file_type").isin(1, 202)
    simple = F.when(passed, plain).when(is_native & (F.col("file_type") == 1), native.html_text(plain, own.bare_references)).when(is_native, native.vsd_text(F.col("content")))
    found = extract_text(F.col("file_type"), F.when(~is_native, F.col("content")), F.col("path"), own)
    rows = rows.withColumn("simple", simple).withColumn("r", found)
    text = F.coalesce("simple", "r.text", F.lit(""))
    kept = F.coalesce(F.when(passed, F.col("content")), text.cast("binary"))
    size = textnorm.byte_length(kept if with_bytes else text)
    return rows.select(
        *keep, "path", "file_type", filetypes.type_class(F.col("file_type")).alias("class"), F.coalesce("r.method", filetypes.extractor_name(F.col("file_type"))).alias("method"), text.alias("text"), size.alias("size"),
        F.coalesce("r.n_parts", F.lit(1)).alias("n_parts"), F.when(F.col("content").isNull(), "no content").otherwise(F.col("r.error")).alias("error"),
        *([kept.alias("bytes")] if with_bytes else []),
    )


def archive_entries(files: DataFrame, file_type: int | None = None, registry: Registry | None = None) -> DataFrame:
    """One row for each file in each archive: path, entry_path (a part for each level), depth, file_type, text, size, method, error.

    The entries of an archive are read within the limits, then leave in walk order. An archive that cannot be opened is one row
    without an entry; one that is damaged or beyond a limit gives what was read and a row that tells the error.
    """
    own = registry or Registry()
    code = F.lit(file_type).cast("int") if file_type else filetypes.detect_type(F.col("path"))

    def entries(path: str | None, data: bytes | None, kind: int):
        try:
            for e in _walk(own, kind, data, path or ""):
                text = e.text.encode("utf-8", "replace")
                yield path, list(e.path), len(e.path), e.file_type, text.decode(), len(text), e.method, e.error
        except ExtractError as e:
            yield path, None, 0, kind, "", 0, filetypes.EXTRACTORS.get(kind, "raw"), str(e)

    return files.select("path", "content", code.alias("kind")).mapInArrow(rowwise.table(entries, _ENTRY), _ENTRY_DDL)


def _walk(own: Registry, code: int, data: bytes | None, path: str):
    kind = filetypes.EXTRACTORS.get(code)
    if data is None or kind not in KINDS:
        raise ExtractError("no archive")
    return walk(kind, data, path, own.extract, own.limits, own.fail_fast)


def fold_entries(entries: DataFrame, by: str = "path", name: str = "entry_path", text: str = "text") -> DataFrame:
    """The folded text of each archive from rows of its files (``name``: an array of path parts), in walk order."""
    before, between, after = BLOCK.split("{}")
    block = F.concat(F.lit(before), F.array_join(name, "/"), F.lit(between), F.col(text), F.lit(after))
    held = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), block.alias("v"))))
    return entries.groupBy(by).agg(F.array_join(F.transform(held, lambda x: x["v"]), "").alias("text"))


def register(spark: SparkSession, registry: Registry | None = None) -> None:
    """SQL functions ``extract_text(file_type, content, path)`` and table function ``archive_entries(path, content)``."""
    own = registry or Registry()

    def text_of(code: int, data: bytes | None, path: str | None) -> str | None:
        return None if data is None else own.safely(code, data, path or "").text

    extract_text_sql = rowwise.function(text_of, "string", pa.string())

    @F.udtf(returnType="entry_path string, depth int, file_type int, text string, error string")
    class Entries:
        def eval(self, path: str, content: bytes):
            try:
                for e in _walk(own, filetypes.detect(path or ""), content, path or ""):
                    yield "!".join(e.path), len(e.path), e.file_type, e.text, e.error
            except ExtractError as e:
                yield None, 0, None, None, str(e)

    spark.udf.register("extract_text", extract_text_sql)
    spark.udtf.register("archive_entries", Entries)
