"""XLSB: binary workbook parts within a ZIP container."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .legacy import _ERRORS, number, rk
from .result import ExtractError, Result
from .zipped import Container

#: The header of a sheet, and record types.
HEADER = "工作表: {}\n"
ROW, RK, ERROR, BOOL, REAL, STRING, SHARED, ITEM = 0, 2, 3, 4, 5, 6, 7, 19
_FORMULA = {8: STRING, 9: REAL, 10: BOOL, 11: ERROR}


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at, n = 0, len(data)

    def varint(most: int) -> int:
        nonlocal at
        value = 0
        for k in range(most):
            if at >= n:
                raise ExtractError("xlsb: a record is cut off")
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << 7 * k
            if not byte & 0x80:
                break
        return value

    while at < n:
        kind = data[at]
        at += 1
        if kind & 0x80:
            if at >= n:
                raise ExtractError("xlsb: a record is cut off")
            kind, at = (kind & 0x7F) | (data[at] & 0x7F) << 7, at + 1
        size = varint(4)
        yield kind, data[at : at + size]
        at += size


def _string(raw: bytes, at: int) -> str:
    size = struct.unpack_from("<I", raw, at)[0]
    return raw[at + 4 : at + 4 + 2 * size].decode("utf-16-le", "replace")


def _value(kind: int, raw: bytes, shared: list[str]) -> str:
    kind = _FORMULA.get(kind, kind)
    if kind == RK:
        return number(rk(struct.unpack_from("<I", raw, 8)[0]))
    if kind == REAL:
        return number(struct.unpack_from("<d", raw, 8)[0])
    if kind == BOOL:
        return "TRUE" if raw[8] else "FALSE"
    if kind == ERROR:
        return _ERRORS.get(raw[8], "#N/A")
    if kind == STRING:
        return _string(raw, 8)
    if kind == SHARED:
        i = struct.unpack_from("<I", raw, 8)[0]
        return shared[i] if i < len(shared) else ""
    return ""


def extract_xlsb(data: bytes, name: str = "") -> Result:
    box, shared, parts = Container(data), [], []
    names = box.names()
    try:
        if "xl/sharedStrings.bin" in names:
            shared = [_string(raw, 1) for kind, raw in _records(box.read("xl/sharedStrings.bin")) if kind == ITEM]
        for part in names:
            if not re.fullmatch(r"xl/worksheets/sheet\d+\.bin", part):
                continue
            rows: list[list[str]] = []
            for kind, raw in _records(box.read(part)):
                if kind == ROW:
                    rows.append([])
                elif rows and (value := _value(kind, raw, shared)):
                    rows[-1].append(value)
            parts.append((part.rpartition("/")[2].removesuffix(".bin"), "".join("\t".join(r) + "\n" for r in rows if r)))
    except (struct.error, IndexError) as e:
        raise ExtractError("xlsb: a record is cut off") from e
    return Result("".join(HEADER.format(s) + t for s, t in parts), "xlsb", parts)
