"""Cells of workbooks as rows, shared strings being looked up by a join.

A workbook's parts become rows, the string table becomes rows of (path, index, text) and the sheets become rows of cells; a cell that names
a string by number meets it in a join on (path, index). So neither a workbook's strings nor its cells are held together anywhere but in the
text of their part, and the join is split by adaptive execution where one workbook or one string has most cells.

Elements are found by patterns for any namespace prefix; text is that of ``t`` elements outside phonetic runs, with references decoded.
Defined cases: a file that is no zip has no cells and a row in :func:`workbook_parts` that tells why; a number beyond the table stays as it is, as
does a cell without a type; empty cells are left out; a row without a number counts on by its place; a null content has no parts.
"""

from __future__ import annotations

import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import textnorm
from textloom.operators import members, native
from textloom.operators.result import Limits
from textloom.sources.archives import ENTRY_BYTES

from . import rowwise

_PARTS = pa.schema([("path", pa.string()), ("part", pa.string()), ("content", pa.binary()), ("error", pa.string())])
_WANTED = re.compile(r"xl/(?:sharedStrings|worksheets/sheet\d*)\.xml")
STRINGS = "xl/sharedStrings.xml"
_P = r"(?:[A-Za-z_][A-Za-z0-9_.-]*+:)?"


def workbook_parts(files: DataFrame, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """path, part, content, error: the string table and the sheets of each workbook of ``files`` (path, content).

    For workbooks in a store, the data source of archives gives such rows without reading whole files.
    """
    most = min(entry_bytes, Limits().expanded_bytes)

    def found(path: str, data: bytes):
        try:
            f = io.BytesIO(data)
            start, end, _ = members.zip_directory(f, len(data))
            names = {m.name: m.position for m in members.zip_members(f, len(data), start, end, most, content=False) if _WANTED.fullmatch(m.name)}
            for m in members.zip_members(f, len(data), start, end, most, lambda m: names.get(m.name) == m.position):
                if m.content is not None or m.error:
                    yield path, m.name, m.content, m.error
        except members.Damaged as e:
            yield path, None, None, str(e)

    return files.where("content IS NOT NULL").select("path", "content").mapInArrow(rowwise.table(found, _PARTS), "path string, part string, content binary, error string")


def _elements(xml: Column, name: str) -> Column:
    """Whole elements of a name that do not hold one another, in order."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{_P}{name}(?:\s[^>]*+)?(?:(?<=/)>|>(?<!/>).*?</{_P}{name}\s*+>)|<{_P}{name}/>"), F.lit(0))


def _inside(element: Column, name: str) -> Column:
    """What the elements of a name hold, in order."""
    return F.regexp_extract_all(element, F.lit(rf"(?s)<{_P}{name}(?:\s[^>]*+)?>(?<!/>)(.*?)</{_P}{name}\s*+>"), F.lit(1))


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"""^<[^>]*?\s{name}\s*+=\s*+["']([^"'>]*+)["']""", 1)


def _text(element: Column) -> Column:
    runs = F.regexp_replace(element, rf"(?s)<{_P}rPh[\s>].*?</{_P}rPh\s*+>", "")
    return textnorm.unescape(F.array_join(_inside(runs, "t"), ""))


def shared_strings(parts: DataFrame) -> DataFrame:
    """path, index, string for each item of each string table."""
    xml = native.plain_text(F.col("content"))
    items = parts.where(F.col("part") == STRINGS).select("path", F.posexplode(_elements(xml, "si")).alias("index", "item"))
    return items.select("path", F.col("index").cast("bigint").alias("index"), _text(F.col("item")).alias("string"))


def cells(parts: DataFrame) -> DataFrame:
    """path, sheet, row_no, cell_no (place within the row, from 1), ref, value of each cell that is not empty."""
    xml = native.plain_text(F.col("content"))
    rows = parts.where("part LIKE 'xl/worksheets/%'").select("path", F.substring_index("part", "/", -1).alias("sheet"), F.posexplode(_elements(xml, "row")).alias("at", "row"))
    number = F.coalesce(F.expr("nullif(try_cast(number AS BIGINT), 0)"), F.col("at") + 1)
    rows = rows.withColumn("number", _attribute(F.col("row"), "r")).select("path", "sheet", number.alias("row_no"), F.posexplode(_elements(F.col("row"), "c")).alias("cell_no", "cell"))
    cell = F.col("cell")
    value = F.when(F.col("type") == "inlineStr", _text(cell)).otherwise(textnorm.unescape(F.coalesce(F.get(_inside(cell, "v"), F.lit(0)), F.lit(""))))
    found = rows.withColumn("type", _attribute(cell, "t")).select("path", "sheet", "row_no", (F.col("cell_no") + 1).alias("cell_no"), _attribute(cell, "r").alias("ref"), value.alias("written"), "type")
    found = found.where("written <> ''").withColumn("index", F.when((F.col("type") == "s") & F.col("written").rlike("^[0-9]{1,18}$"), F.col("written").cast("bigint")))
    strings = shared_strings(parts).withColumnRenamed("path", "of")
    both = found.join(strings, (found["path"] == strings["of"]) & (found["index"] == strings["index"]), "left")
    return both.select("path", "sheet", "row_no", "cell_no", "ref", F.coalesce("string", "written").alias("value")).where("value <> ''")


def sheet_lines(found: DataFrame) -> DataFrame:
    """path, sheet, row_no, line: the values of a row with tabs between, in order. A row has at most 16,384 cells."""
    held = F.array_sort(F.collect_list(F.struct("cell_no", "value")))
    return found.groupBy("path", "sheet", "row_no").agg(F.array_join(F.transform(held, lambda x: x["value"]), "\t").alias("line"))
