"""File types by name: the suffix table, as a Python function and as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of file types by suffix.
SUFFIXES = {
    "html": 1, "txt": 2, "xml": 3, "json": 4, "csv": 5, "doc": 7, "docx": 8, "xls": 9, "xlsx": 10, "ppt": 11, "pptx": 12, "pdf": 13, "xlsb": 14,
    "odt": 15, "rtf": 16, "tar": 18, "gz": 19, "tar.gz": 20, "zip": 21, "7z": 22, "rar": 23, "bz2": 24, "jar": 25, "war": 26, "arj": 27, "lzh": 28,
    "xz": 29, "jpeg": 31, "jpg": 31, "png": 32, "tif": 33, "tiff": 33, "webp": 34, "wbmp": 35, "vsdx": 201, "vsd": 202, "fpx": 401, "pbm": 402,
    "pgm": 403, "bmp": 404,
}
#: Codes of further suffixes by class.
OTHER_SUFFIXES = {
    6: "md css js log ini py go java c cpp h sh bat php rb".split(),
    17: "odp ods pages key numbers wpd".split(),
    30: "zipx tar.bz2 tar.xz rar5 z".split(),
    36: "gif ico svg jpe".split(),
}
UNKNOWN = 114
TYPES = SUFFIXES | {s: code for code, suffixes in OTHER_SUFFIXES.items() for s in suffixes}
CLASSES = {"text": range(1, 7), "document": (*range(7, 18), 201, 202), "archive": range(18, 31), "image": (*range(31, 37), 401, 402, 403, 404)}
#: Names of the extractors; types that are not listed have raw bytes.
EXTRACTORS = {
    1: "html", 2: "text", 3: "xml", 4: "text", 5: "text", 6: "markdown", 7: "doc", 8: "docx", 9: "xls", 10: "xlsx", 11: "ppt", 12: "pptx", 13: "pdf",
    14: "xlsb", 15: "odt", 16: "rtf", 18: "tar", 19: "gz", 20: "gz", 21: "zip", 22: "7z", 23: "rar", 24: "bz2", 25: "zip", 26: "zip", 29: "xz",
    201: "vsdx", 202: "vsd",
}


def class_of(code: int) -> str:
    return next((name for name, codes in CLASSES.items() if code in codes), "other")


def extension(name: str) -> str:
    """``tar.gz`` for names that end with it, else what follows the last dot of the last part."""
    name = name.lower()
    if name.endswith("tar.gz"):
        return "tar.gz"
    last = name.rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[1] if "." in last else ""


def detect(name: str) -> int:
    return TYPES.get(extension(name), UNKNOWN)


def extension_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit("tar.gz")), "tar.gz").otherwise(F.regexp_extract(low, r"[.]([^./]*)$", 1))


def detect_type(name: Column) -> Column:
    """The code of a file name's type; a literal map, so no join and no Python."""
    table = F.create_map(*[F.lit(x) for item in TYPES.items() for x in item])
    return F.coalesce(F.element_at(table, extension_of(name)), F.lit(UNKNOWN)).cast("int")


def _by_code(code: Column, names: dict[int, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.element_at(table, code.cast("int")), F.lit(other))


def type_class(code: Column) -> Column:
    return _by_code(code, {c: class_of(c) for c in sorted({*TYPES.values(), UNKNOWN})}, "other")


def extractor_name(code: Column) -> Column:
    return _by_code(code, EXTRACTORS, "raw")


def file_types(spark: SparkSession) -> DataFrame:
    """The dimension table ext, file_type, class, extractor: about 65 rows, so it may be broadcast."""
    rows = [(ext, code, class_of(code), EXTRACTORS.get(code, "raw")) for ext, code in TYPES.items()]
    return spark.createDataFrame(rows, "ext string, file_type int, class string, extractor string")
