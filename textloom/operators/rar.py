"""RAR archives, versions 4 and 5: entries that are stored. Compressed ones are errors of their own."""

from __future__ import annotations

import struct

from .result import ExtractError

FOUR, FIVE = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"


def entries(data: bytes) -> list[tuple[str, bytes, str | None]]:
    """Names, content and error of the files of an archive."""
    try:
        if data.startswith(FIVE):
            return list(_five(data))
        if data.startswith(FOUR):
            return list(_four(data))
    except (struct.error, IndexError) as e:
        raise ExtractError("rar: a header is cut off") from e
    raise ExtractError("no RAR signature")


def _four(data: bytes):
    at = len(FOUR)
    while at + 7 <= len(data):
        _, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        if size < 7 or kind == 0x7B:
            return
        more = struct.unpack_from("<I", data, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x74:
            full = more | (struct.unpack_from("<I", data, at + 32)[0] << 32 if flags & 0x100 else 0)
            method, n = data[at + 25], struct.unpack_from("<H", data, at + 26)[0]
            start = at + (40 if flags & 0x100 else 32)
            raw = data[start : start + n]
            name = raw.split(b"\0")[0].decode("utf-8", "replace").replace("\\", "/")
            if flags & 0xE0 != 0xE0:  # no folder
                yield _entry(name, method == 0x30 and not flags & 4, data[at + size : at + size + full])
            more = full
        at += size + more


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(10):
        byte = data[at]
        at += 1
        value |= (byte & 127) << 7 * k
        if not byte & 128:
            break
    return value, at


def _five(data: bytes):
    at = len(FIVE)
    while at + 7 <= len(data):
        size, body = _varint(data, at + 4)
        end = body + size
        kind, p = _varint(data, body)
        flags, p = _varint(data, p)
        _, p = _varint(data, p) if flags & 1 else (0, p)
        n, p = _varint(data, p) if flags & 2 else (0, p)
        if kind == 5:
            return
        if kind == 2:
            file_flags, p = _varint(data, p)
            _, p = _varint(data, p)
            _, p = _varint(data, p)
            p += (4 if file_flags & 2 else 0) + (4 if file_flags & 4 else 0)
            how, p = _varint(data, p)
            _, p = _varint(data, p)
            length, p = _varint(data, p)
            name = data[p : p + length].decode("utf-8", "replace")
            if not file_flags & 1:
                yield _entry(name, how >> 7 & 7 == 0, data[end : end + n])
        at = end + n


def _entry(name: str, stored: bool, raw: bytes) -> tuple[str, bytes, str | None]:
    return (name, raw, None) if stored else (name, b"", "rar: the method is not supported")
