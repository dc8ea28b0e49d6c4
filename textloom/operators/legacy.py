"""DOC, PPT and XLS: records within compound files."""

from __future__ import annotations

import struct

from textloom.functions import textnorm

from .cfb import CompoundFile
from .result import ExtractError, Result

#: Fixed value: the header before each text of a presentation.
PPT_HEADER = "=== 文本内容 ===\n{}\n\n"
XLS_HEADER = "\n--- 工作表 {}: {} ---\n"
TEXT_CHARS, TEXT_BYTES, C_STRING = 0x0FA0, 0x0FA8, 0x0FBA


def _pieces(table: bytes) -> list[tuple[int, int, int]]:
    """Start and end in characters, and file position, of each text piece in a CLX."""
    at = 0
    while at < len(table) and table[at] == 1:
        if at + 3 > len(table):
            break
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at + 5 > len(table) or table[at] != 2:
        raise ExtractError("doc: no piece table")
    size = struct.unpack_from("<I", table, at + 1)[0]
    n = (size - 4) // 12
    if n < 1 or at + 5 + 4 + 12 * n > len(table):
        raise ExtractError("doc: the piece table is cut off")
    bounds = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    return [(bounds[i], bounds[i + 1], struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]) for i in range(n)]


def extract_doc(data: bytes, name: str = "", ansi_encoding: str = "gbk") -> Result:
    file = CompoundFile(data)
    main = file.stream("WordDocument")
    if len(main) < 34 or struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ExtractError("doc: no file information block")
    table = file.stream("1Table" if struct.unpack_from("<H", main, 10)[0] & 0x0200 else "0Table")
    at = 32
    words = struct.unpack_from("<H", main, at)[0]
    at += 2 + 2 * words
    if at + 2 > len(main):
        raise ExtractError("doc: the file information block is cut off")
    longs = struct.unpack_from("<H", main, at)[0]
    n_text = struct.unpack_from("<I", main, at + 2 + 12)[0]
    at += 2 + 4 * longs
    if at + 2 + 8 * 34 > len(main) or struct.unpack_from("<H", main, at)[0] < 34:
        raise ExtractError("doc: the file information block is cut off")
    start, size = struct.unpack_from("<II", main, at + 2 + 8 * 33)
    if not size:
        raise ExtractError("doc: no piece table")
    out = []
    for first, last, position in _pieces(table[start : start + size]):
        n = min(last, n_text) - first
        if n <= 0:
            break
        if position & 0x40000000:
            begin = (position & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + n].decode(ansi_encoding, "replace"))
        else:
            begin = position & 0x3FFFFFFF
            out.append(main[begin : begin + 2 * n].decode("utf-16-le", "replace"))
    return Result("".join(out), "doc", [(str(i), t) for i, t in enumerate(out)])


def _utf16(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[2 if raw[:2] == b"\xff\xfe" else 0 :].decode("utf-16-le", "replace")


def extract_ppt(data: bytes, name: str = "", as_written: bool = False) -> Result:
    """``as_written`` keeps blank texts, and all white space and marks of the others."""
    stream, at, found = CompoundFile(data).stream("PowerPoint Document"), 0, []
    while at + 8 <= len(stream):
        version, kind, size = struct.unpack_from("<HHI", stream, at)
        at += 8
        if version & 0xF == 0xF:  # a container: its records follow
            continue
        raw = stream[at : at + size]
        at += size
        if kind in (TEXT_CHARS, C_STRING):
            text = raw.decode("utf-16-le", "replace") if as_written else _utf16(raw)
        elif kind == TEXT_BYTES:
            text = raw.decode("latin-1")
        else:
            continue
        if as_written:
            found.append(text)
        elif text := textnorm.py_trim_space(text.replace("\r", "\n").replace("\x0b", "\n")):
            found.append(text)
    return Result("".join(map(PPT_HEADER.format, found)), "ppt", [(str(i), t) for i, t in enumerate(found)])


def number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def rk(raw: int) -> float:
    """The number that 32 bits of the RK form stand for."""
    value = float(raw >> 2 if not raw & 0x80000000 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Strings:
    """Reads strings that go on over CONTINUE records, each of which starts with a new width flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            some = self.parts[self.part][self.at : self.at + n - len(out)]
            out += some
            self.at += len(some)
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
        if len(out) < n:
            raise ExtractError("xls: strings are cut off")
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.part >= len(self.parts):
                raise ExtractError("xls: strings are cut off")
            room = len(self.parts[self.part]) - self.at
            k = min(n, room // 2 if wide else room)
            if k:
                out.append(self.take(2 * k if wide else k).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= k
            if n:
                if self.at:
                    self.part, self.at = self.part + 1, 0
                wide = self.take(1)[0] & 1
        self.take(4 * runs + extra)
        return "".join(out)


def _records(stream: bytes, at: int = 0):
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


def _short(raw: bytes, wide_count: bool) -> str:
    n, at = (struct.unpack_from("<H", raw)[0], 2) if wide_count else (raw[0], 1)
    wide = raw[at] & 1
    return raw[at + 1 : at + 1 + (2 * n if wide else n)].decode("utf-16-le" if wide else "latin-1", "replace")


_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _cells(stream: bytes, start: int, shared: list[str]) -> dict[tuple[int, int], str]:
    cells: dict[tuple[int, int], str] = {}
    pending, depth = None, 0
    for _, kind, raw in _records(stream, start):
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if depth <= 0:
                break
        elif depth != 1:
            continue
        elif kind == 0x00FD and len(raw) >= 10:
            i = struct.unpack_from("<I", raw, 6)[0]
            cells[struct.unpack_from("<HH", raw)] = shared[i] if i < len(shared) else ""
        elif kind == 0x0204 and len(raw) >= 9:
            cells[struct.unpack_from("<HH", raw)] = _short(raw[6:], True)
        elif kind == 0x0203 and len(raw) >= 14:
            cells[struct.unpack_from("<HH", raw)] = number(struct.unpack_from("<d", raw, 6)[0])
        elif kind == 0x027E and len(raw) >= 10:
            cells[struct.unpack_from("<HH", raw)] = number(rk(struct.unpack_from("<I", raw, 6)[0]))
        elif kind == 0x00BD and len(raw) >= 6:
            row, column = struct.unpack_from("<HH", raw)
            for k in range((len(raw) - 6) // 6):
                cells[row, column + k] = number(rk(struct.unpack_from("<I", raw, 6 + 6 * k)[0]))
        elif kind == 0x0205 and len(raw) >= 8:
            cells[struct.unpack_from("<HH", raw)] = _ERRORS.get(raw[6], "#N/A") if raw[7] else ("TRUE" if raw[6] else "FALSE")
        elif kind == 0x0006 and len(raw) >= 14:
            at = struct.unpack_from("<HH", raw)
            if raw[12:14] != b"\xff\xff":
                cells[at] = number(struct.unpack_from("<d", raw, 6)[0])
            elif raw[6] == 0:
                pending = at
            elif raw[6] == 1:
                cells[at] = "TRUE" if raw[8] else "FALSE"
            elif raw[6] == 2:
                cells[at] = _ERRORS.get(raw[8], "#N/A")
        elif kind == 0x0207 and pending:
            cells[pending], pending = _short(raw, True), None
    return cells


def extract_xls(data: bytes, name: str = "") -> Result:
    stream = CompoundFile(data).stream("Workbook", "Book")
    bounds: list[tuple[int, str]] = []
    strings: list[bytes] = []
    total = 0
    previous = None
    for _, kind, raw in _records(stream):
        if kind == 0x0085 and len(raw) >= 8:
            bounds.append((struct.unpack_from("<I", raw)[0], _short(raw[6:], False)))
        elif kind == 0x00FC and len(raw) >= 8:
            total, strings = struct.unpack_from("<I", raw, 4)[0], [raw[8:]]
        elif kind == 0x003C and previous == 0x00FC:
            strings.append(raw)
            continue
        elif kind == 0x000A:
            break
        previous = kind
    reader, shared = _Strings(strings), []
    for _ in range(total):
        shared.append(reader.string())
    parts = []
    for start, sheet in bounds:
        cells = _cells(stream, start, shared)
        rows: dict[int, dict[int, str]] = {}
        for (r, c), v in cells.items():
            rows.setdefault(r, {})[c] = v
        lines = []
        for r in sorted(rows):
            last = max(rows[r])
            text = "".join(v + ("\t" if c < last else "") for c, v in sorted(rows[r].items()) if v)
            if text:
                lines.append(text + "\n")
        parts.append((sheet, "".join(lines)))
    return Result("".join(XLS_HEADER.format(i, s) + t for i, (s, t) in enumerate(parts, 1)), "xls", parts)
