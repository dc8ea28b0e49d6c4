"""Which encoding bytes are in: utf-8, utf-16le, utf-16be, gbk or big5, with a confidence from 0 to 1.

A byte order mark decides. Otherwise each encoding is scored by how much of the text is in the blocks that it uses most: pairs of
bytes are read from the left as the encoding would, and those of frequent blocks count fully, other valid ones in part and bytes that fit in no
pair against it. Of valid UTF-8, characters of rare blocks and Cyrillic letters next to Latin ones, which pairs of gbk look like, count in part. The confidence is the best score less half of the next one. All is done by linear patterns on the bytes as Latin-1, as expressions
(``detect``) and in Python (``py_detect``), with equal results. Null gives nulls; empty and plain ASCII are utf-8. Texts of very few letters may be valid
in several encodings; of equal scores the first in the order above wins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import binary

#: Blocks of each double-byte encoding that hold punctuation and the most frequent characters, and all of its pairs.
_PAIRS = {
    "gbk": (r"[\xA1-\xA3\xB0-\xD7][\xA1-\xFE]", r"[\x81-\xFE][\x40-\x7E\x80-\xFE]"),
    "big5": (r"[\xA1-\xA2\xA4-\xC6][\x40-\x7E\xA1-\xFE]", r"[\x81-\xFE][\x40-\x7E\xA1-\xFE]"),
}
#: Basic Cyrillic letters and the others, and characters of UTF-8 that texts are made of: Latin with marks, Greek, Cyrillic words with a basic
#: letter that touch no Latin one, scripts of the Near East, and all of three or four bytes. Other Cyrillic is the group.
_BASIC, _OTHER = r"\xD0[\x80-\xBF]|\xD1[\x80-\x9F]", r"\xD1[\xA0-\xBF]|[\xD2\xD3][\x80-\xBF]|\xD4[\x80-\xAF]"
#: A pair of gbk that is a usual letter of Slovak counts as that next to a vowel, before a lower-case letter or next to another letter with a mark.
_SOFT_L = r"(?:(?<=[aeiouy])|(?<=[\xC3-\xC5][\x80-\xBF])(?<!\xC4\xBE))\xC4\xBE|\xC4\xBE(?=[a-jl-pr-vy]|(?!\xC4\xBE)[\xC3-\xC5][\x80-\xBF])"
#: And one that is a Cyrillic letter is that of gbk in a text with no other letters but ASCII.
_LONE = r"(?:\xD0\xA1)++"
_COMMON = (
    rf"[\x00-\x7F]++|{_SOFT_L}|"
    r"(?:(?!\xC4\xBE)(?:[\xC2-\xC5\xCC\xCE\xCF\xD5-\xDF][\x80-\xBF]|\xC6[\x8F\xA0\xA1\xAF\xB0]|\xC8[\x98-\x9B]|\xC9\x99|\xD4[\xB1-\xBF]))++|(?:[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3})++"
    rf"|(?<![A-Za-z])(?<![\xC3-\xC9][\x80-\xBF])(?=(?:{_OTHER})*+(?:{_BASIC}))(?:{_BASIC}|{_OTHER})++(?![A-Za-z\xC3-\xC9])|((?:{_BASIC}|{_OTHER})++)"
)
#: Units of UTF-16 that texts are made of, as (low byte, high byte): Latin, Greek and Cyrillic, punctuation, signs of East Asia, Han, wide forms.
_UNITS = ((r"[\t\n\r\x20-\x7E\xA0-\xFF]", r"\x00"), (r"[\x00-\xFF]", r"[\x01\x03\x04]"), (r"[\x10-\x3A]", r"\x20"), (r"[\x00-\x1F\x41-\xFF]", r"\x30"), (r"[\x00-\xFF]", r"[\x4E-\x9F\xAC-\xD7]"), (r"[\x01-\x5E]", r"\xFF"))
#: Runs of one block at a time, so that matches are few; possessive ones of fixed length use no stack.
_LITTLE, _BIG = "|".join(f"(?:{low}{high})++" for low, high in _UNITS), "|".join(f"(?:{high}{low})++" for low, high in _UNITS)
_LITTLE_LATIN, _BIG_LATIN = _LITTLE.split("|")[0], _BIG.split("|")[0]
ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "gbk", "big5")
#: What a valid pair of a rare block is worth; a text in units, where ASCII letters in pairs may look like Han; and units that are not Latin,
#: since Latin ones look like Han in the other order.
RARE, UNITS, NOT_LATIN = 0.25, 0.98, 0.9


def _rest(text: Column, pattern: str, kept: str = "") -> Column:
    return F.length(F.regexp_replace(text, f"(?s){pattern}", kept))


def detect(content: Column) -> Column:
    """``encoding`` and ``confidence`` of some bytes."""
    latin = F.decode(content, "ISO-8859-1")
    mark = F.hex(F.substring(content, 1, 3))
    told = lambda name, sure: F.struct(F.lit(name).alias("encoding"), F.lit(sure).cast("double").alias("confidence"))
    size = F.octet_length(content)
    high = size - _rest(latin, r"[\x80-\xFF]+")
    zeros = (size - _rest(latin, r"\x00+")) / size

    def pairs(frequent: str, valid: str) -> Column:
        often, any_, lost = _rest(latin, rf"[\x00-\x7F]++|((?:{frequent})++)|{valid}|.", "$1"), _rest(latin, rf"[\x00-\x7F]++|((?:{valid})++)|.", "$1"), _rest(latin, rf"[\x00-\x7F]++|(?:{valid})++")
        return F.when(high > 0, F.greatest(F.lit(0.0), (often + (any_ - often) * RARE - lost) / (high + (any_ - (high - lost))) - 2 * zeros)).otherwise(0.0)

    def units(pattern: str, letters: str) -> Column:
        return F.when(size % 2 == 0, (_rest(latin, f"({pattern})|..", "$1") * NOT_LATIN + _rest(latin, f"({letters})|..", "$1") * (1 - NOT_LATIN)) / size * UNITS).otherwise(0.0)

    unusual = F.when(high > 0, F.when(high == size - _rest(latin, _LONE), high).otherwise(_rest(latin, _COMMON, "$1")) * (1 - RARE) / high).otherwise(0.0)
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.greatest(F.lit(0.0), 1 - 2 * zeros - unusual)).otherwise(0.0)
    scores = F.array(*(F.struct(score.cast("double").alias("score"), F.lit(-i).alias("order")) for i, score in enumerate((utf8, units(_LITTLE, _LITTLE_LATIN), units(_BIG, _BIG_LATIN), pairs(*_PAIRS["gbk"]), pairs(*_PAIRS["big5"])))))
    names = F.array(*map(F.lit, ENCODINGS))

    def best(ranked: Column) -> Column:
        first, second = ranked[0]["score"], ranked[1]["score"]
        # what fits no encoding is passed on as UTF-8
        return F.struct(F.when(first > 0, F.get(names, -ranked[0]["order"])).otherwise("utf-8").alias("encoding"), F.round(first - second / 2, 6).alias("confidence"))

    scored = F.element_at(F.transform(F.array(F.sort_array(scores, asc=False)), best), 1)
    sure = F.when(size == 0, told("utf-8", 1.0)).when(F.startswith(mark, F.lit("EFBBBF")), told("utf-8", 1.0)).when(F.startswith(mark, F.lit("FFFE")), told("utf-16le", 1.0)).when(F.startswith(mark, F.lit("FEFF")), told("utf-16be", 1.0))
    none = F.struct(F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("double").alias("confidence"))
    return F.when(content.isNull(), none).otherwise(sure.otherwise(scored))


def py_detect(data: bytes) -> tuple[str, float]:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return name, 1.0
    if not data:
        return "utf-8", 1.0
    latin, size = data.decode("latin-1"), len(data)
    rest = lambda pattern, kept="": len(re.sub(f"(?s){pattern}", kept, latin))
    high, zeros = size - rest(r"[\x80-\xFF]+"), data.count(0) / size
    try:
        data.decode()
        strange = high if high == size - rest(_LONE) else rest(_COMMON, r"\1")
        scores = [max(0.0, 1 - 2 * zeros - (strange * (1 - RARE) / high if high else 0.0))]
    except UnicodeDecodeError:
        scores = [0.0]
    for pattern, letters in ((_LITTLE, _LITTLE_LATIN), (_BIG, _BIG_LATIN)):
        scores.append((rest(f"({pattern})|..", r"\1") * NOT_LATIN + rest(f"({letters})|..", r"\1") * (1 - NOT_LATIN)) / size * UNITS if size % 2 == 0 else 0.0)
    for frequent, valid in _PAIRS.values():
        often, any_, lost = rest(rf"[\x00-\x7F]++|((?:{frequent})++)|{valid}|.", r"\1"), rest(rf"[\x00-\x7F]++|((?:{valid})++)|.", r"\1"), rest(rf"[\x00-\x7F]++|(?:{valid})++")
        scores.append(max(0.0, (often + (any_ - often) * RARE - lost) / (high + (any_ - (high - lost))) - 2 * zeros) if high else 0.0)
    ranked = sorted(range(5), key=lambda i: (-scores[i], i))
    return ENCODINGS[ranked[0]] if scores[ranked[0]] > 0 else "utf-8", round(scores[ranked[0]] - scores[ranked[1]] / 2, 6)


def py_decode(data: bytes, encoding: str) -> str:
    """Text without a byte order mark; what is not valid becomes U+FFFD."""
    return data.decode(encoding, "replace").removeprefix("﻿")


@F.pandas_udf(StringType())
def _double_byte(contents: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else py_decode(bytes(c), e) for c, e in zip(contents, encodings, strict=True)], dtype=object)


def decode(content: Column, encoding: Column) -> Column:
    """The text of bytes in one of ``ENCODINGS``: by expressions but for gbk and big5, whose bytes alone go to Python."""
    double = encoding.isin("gbk", "big5")
    marked = lambda mark: F.startswith(F.hex(F.substring(content, 1, 3)), F.lit(mark))
    unmarked = lambda mark, n: F.when(marked(mark), F.substring(content, F.lit(n + 1), F.octet_length(content))).otherwise(content)
    native = F.when(encoding == "utf-16le", binary.utf16(unmarked("FFFE", 2))).when(encoding == "utf-16be", binary.utf16(unmarked("FEFF", 2), big=True)).when(encoding == "utf-8", F.make_valid_utf8(unmarked("EFBBBF", 3).cast("string")))
    return F.coalesce(native, _double_byte(F.when(double, content), F.when(double, encoding)))


def with_text(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with ``encoding``, ``confidence`` and ``text`` in place of columns of these names."""
    bare = rows.drop(*({"encoding", "confidence", "text"} - {content}))
    # a generator, since a projection would be merged with those that use it, and detection done for each use
    found = bare.select("*", F.inline(F.array(detect(F.col(content)))))
    return found.withColumn("text", decode(F.col(content), F.col("encoding")))
