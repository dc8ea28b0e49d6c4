"""Numbers, bits and text in bytes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned number of one to seven bytes from offset ``at``; null if the bytes are not all there."""
    digits = F.hex(F.substring(content, at + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)])
    return F.when(F.octet_length(content) >= at + size, F.conv(swapped, 16, 10).cast("bigint"))


def bits(number: Column, low: int, count: int) -> Column:
    """``count`` bits of a number from bit ``low``."""
    return F.shiftrightunsigned(number.cast("bigint"), low).bitwiseAND(F.lit((1 << count) - 1).cast("bigint"))


def utf16(content: Column, big: bool = False) -> Column:
    """UTF-16 without a mark; a surrogate without its other half and a last byte without its other become U+FFFD each.

    Spark's own decoding ends the job on those, so they are mended before.
    """
    unit = lambda high: rf"[{high}]." if big else rf".[{high}]"
    sound = rf"(?:{unit(r'\x00-\xD7\xE0-\xFF')})++|{unit(r'\xD8-\xDB')}{unit(r'\xDC-\xDF')}"
    # one match for each damage, from the end of the one before, so that units are never taken by halves
    mended = F.regexp_replace(F.decode(content, "ISO-8859-1"), rf"(?s)\G((?:{sound})*+)..?", "$1\xff\xfd" if big else "$1\xfd\xff")
    return F.decode(F.encode(mended, "ISO-8859-1"), "UTF-16BE" if big else "UTF-16LE")


def utf16_text(content: Column) -> Column:
    """UTF-16 by its byte order mark, little-endian without one."""
    mark = F.hex(F.substring(content, 1, 2))
    rest = F.substring(content, 3, F.octet_length(content))
    return F.when(mark == "FEFF", utf16(rest, big=True)).when(mark == "FFFE", utf16(rest)).otherwise(utf16(content))
