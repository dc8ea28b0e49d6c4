"""Fill-in-the-middle: a text's prefix, middle and suffix in an order that lets a model learn to write the middle.

Bit-parallel over big integers. A text's UTF-8 bytes become one integer for each class of bytes that matters, a bit a byte
(``bytes.translate`` makes the digits of a number in base two). Shifts and boolean operations over whole texts mark the last byte of
each unit; ``bit_count`` is the number of units; the k-th mark is found by halving: count the lower half's marks, go on in the half
that has it, so a cut costs about two passes over the bits. Texts are cut as bytes and never become lists of units.

Units: ``char`` (code points), ``word`` (white space and the letters after it; white space at the end is a unit of its own),
``line`` (up to and with a line feed). A row's cuts and form come from the sha256 of ``<seed>:<doc_id>``, so they do not depend on partitions and
a lost task repeats them.

There is no shuffle. Defined cases: a null text is the empty one; empty texts and those that contain a sentinel stay plain, so every
output can be taken apart again; a null id is hashed as the empty text; repeated rows are transformed each, alike; bytes that are no
UTF-8 are cut like others (Spark may hand them over as U+FFFD); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bytes_of, frugal, table
from .op6_packing import _slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SLICE_BYTES = 4 << 20
WORD_BITS = 64


def _digits(members) -> bytes:
    """A translation of bytes to the digits 1, for members of a class, and 0."""
    return bytes(49 if b in members else 48 for b in range(256))


_CONTINUES = _digits(range(0x80, 0xC0))
_SPACE = _digits(b" \t\n\r\x0b\x0c")
_FEED = _digits(b"\n")


def _mask(raw: bytes, digits: bytes) -> int:
    """Bit i tells whether byte i is in the class."""
    return int(raw[::-1].translate(digits), 2)


def unit_ends(raw: bytes, unit: str = "char") -> int:
    """Bit i tells whether byte i is the last of a unit."""
    if not raw:
        return 0
    last = 1 << (len(raw) - 1)
    every = (last << 1) - 1
    if unit == "char":
        return every & ~(_mask(raw, _CONTINUES) >> 1)
    if unit == "word":
        space = _mask(raw, _SPACE)
        return ~space & (space >> 1) & every | last
    if unit == "line":
        return _mask(raw, _FEED) | last
    raise ValueError(f"unknown unit {unit}")


def ranked_bit(bits: int, k: int, size: int) -> int:
    """The place of the k-th set bit, from 0, of an integer of ``size`` bits."""
    at = 0
    while size > WORD_BITS:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, size = low, half
        else:
            bits, size, k, at = bits >> half, size - half, k - below, at + half
    for _ in range(k):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def _cut(ends: int, k: int, size: int) -> int:
    """Bytes before the k-th border between units."""
    return ranked_bit(ends, k - 1, size) + 1 if k else 0


class Transformer:
    def __init__(self, seed: str, rate: int, suffix_first: int, unit: str):
        self.seed, self.rate, self.suffix_first, self.unit = seed, rate, suffix_first, unit
        self.marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def __call__(self, key, raw: bytes) -> tuple:
        """output, n, form, and code points of prefix and middle."""
        digest = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        ends, size = unit_ends(raw, self.unit), len(raw)
        n = ends.bit_count()
        if not raw or h[2] % 100 >= self.rate or any(m in raw for m in self.marks):
            return raw, n, "plain", None, None
        x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = _cut(ends, x, size), _cut(ends, y, size)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        p, s, m = self.marks
        form, output = ("spm", s + suffix + p + prefix + m + middle) if h[3] % 100 < self.suffix_first else ("psm", p + prefix + s + suffix + m + middle)
        points = (x, y - x) if self.unit == "char" else (unit_ends(prefix).bit_count(), unit_ends(middle).bit_count())
        return output, n, form, *points


def transform(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "char") -> DataFrame:
    """doc_id, output, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain)."""
    unit_ends(b"a", unit)
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("output", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches):
        of = Transformer(seed, rate, suffix_first, unit)
        as_text = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
        for b in batches:
            for some in _slices(b, SLICE_BYTES):
                out = list(zip(*(of(k, raw or b"") for k, raw in zip(some.column(0).to_pylist(), bytes_of(some.column(1)), strict=True)), strict=True))
                columns = [pc.cast(pa.array(out[0], pa.binary()), options=as_text), *(pa.array(c, f.type) for c, f in zip(out[1:], list(schema)[2:], strict=True))]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(schema.field(0).type), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind.simpleString()}, output string, n bigint, form string, prefix_chars bigint, middle_chars bigint")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what :func:`transform` made of it.

    No part contains a sentinel and no sentinel ends as it begins, so the first of each kind is the one that was put in.
    """
    head = lambda mark: F.substring(F.split_part(output, F.lit(mark), F.lit(1)), F.lit(4), F.char_length(output))
    between = lambda x, y: F.split_part(F.split_part(output, F.lit(x), F.lit(2)), F.lit(y), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(head(SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, head(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {
    "op13_fill_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
k AS (SELECT doc_id, t, n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS r, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS o FROM h),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""
}
