"""Members of zip and tar archives by position, so that a part of a large archive can be read alone.

A zip is read by its directory, which names where each member lies; a range of the directory is a part of the archive. A tar has no
directory: its headers are a chain, and a part is what the chain visits from one header up to an offset. Bytes that are not what
they should be raise :class:`Damaged`; errors of the store are left to the caller, so that a task fails and runs again.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from .result import ExtractError

BLOCK = 512
#: Bytes of a directory or of headers that are looked at together.
STEP = 1 << 20
#: Where a chain of headers ends with the archive.
END = -1
#: Signatures and record sizes of zip, and the number that points to a wide field.
_DIRECTORY, _LOCAL, _TAIL, _TAIL64, _LOCATOR = b"PK\x01\x02", b"PK\x03\x04", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_RECORD, _HEADER, _TRAILER, _WIDE = 46, 30, 22, 0xFFFFFFFF


class Damaged(ExtractError):
    """Bytes of an archive that are not what they should be, from ``position`` on."""

    def __init__(self, position: int | None, message: str):
        super().__init__(message)
        self.position = position


@dataclass(frozen=True)
class Member:
    """One member; ``position`` rises in the order of the archive."""

    position: int
    name: str
    size: int
    content: bytes | None
    error: str | None


def _exactly(f: BinaryIO, at: int, n: int, what: str) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise Damaged(at, f"{what} is cut off")
    return data


# -- zip -----------------------------------------------------------------------------------------------------------------


def zip_directory(f: BinaryIO, size: int) -> tuple[int, int, int]:
    """Where the directory starts and ends, and how far offsets in it are from offsets in the file."""
    tail_at = max(0, size - _TRAILER - 0xFFFF)
    tail = _exactly(f, tail_at, size - tail_at, "zip: the end")
    at = len(tail)
    while (at := tail.rfind(_TAIL, 0, at)) >= 0:
        if at + _TRAILER <= len(tail) and at + _TRAILER + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail):
            break
    if at < 0:
        raise Damaged(None, "zip: no directory")
    length, start = struct.unpack_from("<II", tail, at + 12)
    end = tail_at + at
    if end >= 20 and (locator := _exactly(f, end - 20, 20, "zip: the end"))[:4] == _LOCATOR:
        # the wide record may lie before where the locator says, if something stands in front of the archive
        wide_at = struct.unpack_from("<Q", locator, 8)[0]
        for at64 in (wide_at, end - 20 - 56):
            if 0 <= at64 <= size - 56 and (wide := _exactly(f, at64, 56, "zip: the end"))[:4] == _TAIL64:
                length, start, end = *struct.unpack_from("<QQ", wide, 40), at64
                break
    shift = end - length - start
    if shift < 0:
        raise Damaged(None, "zip: the directory lies beyond its place")
    return start + shift, end, shift


def _records(f: BinaryIO, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of each record of a range of the directory; a step of it is in memory."""
    data, base = b"", at
    while at < end:
        if len(data) - (at - base) < _RECORD + 3 * 0xFFFF and base + len(data) < end:
            data, base = _exactly(f, at, min(STEP, end - at), "zip: the directory"), at
        i = at - base
        if data[i : i + 4] != _DIRECTORY or i + _RECORD > len(data):
            raise Damaged(at, "zip: damaged directory")
        n = _RECORD + sum(struct.unpack_from("<HHH", data, i + 28))
        if i + n > len(data):
            raise Damaged(at, "zip: damaged directory")
        yield at, data[i : i + n]
        at += n


def zip_parts(f: BinaryIO, size: int, part_bytes: int) -> list[tuple[int, int]]:
    """Ranges of the directory of about so many bytes of members each. The directory is read as a stream; only ranges are kept."""
    start, end, _ = zip_directory(f, size)
    parts, held, first = [], 0, start
    for at, record in _records(f, start, end):
        if held >= part_bytes:
            parts.append((first, at))
            held, first = 0, at
        held += len(record) + _sizes(record)[0]
    return [*parts, (first, end)] if end > first else parts


def _sizes(record: bytes) -> tuple[int, int, int]:
    """Packed size, size and offset of a member, from narrow or wide fields."""
    packed, size = struct.unpack_from("<II", record, 20)
    offset = struct.unpack_from("<I", record, 42)[0]
    if _WIDE not in (packed, size, offset):
        return packed, size, offset
    name, extra = struct.unpack_from("<HH", record, 28)
    at, end = _RECORD + name, _RECORD + name + extra
    while at + 4 <= end:
        kind, n = struct.unpack_from("<HH", record, at)
        if kind == 1:
            # only fields that are full have a wide one, in this order
            wide = iter(struct.unpack_from(f"<{min(n, end - at - 4) // 8}Q", record, at + 4))
            size, packed, offset = (next(wide, x) if x == _WIDE else x for x in (size, packed, offset))
            break
        at += 4 + n
    return packed, size, offset


def zip_members(f: BinaryIO, size: int, first: int, end: int, most: int, content: bool | Callable[[Member], bool] = True) -> Iterator[Member]:
    """Files of a range of the directory, with the content of all, none or those that ``content`` picks. What is wrong with one is its error; a damaged directory is raised."""
    shift = zip_directory(f, size)[2]
    for at, record in _records(f, first, end):
        flags, method = struct.unpack_from("<HH", record, 8)
        raw = record[_RECORD : _RECORD + struct.unpack_from("<H", record, 28)[0]]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        packed, full, offset = _sizes(record)
        if name.endswith("/"):
            continue
        data, error = None, None
        if content(Member(at, name, full, None, None)) if callable(content) else content:
            try:
                data = _zip_content(f, size, record, flags, method, packed, full, offset + shift, most)
            except ExtractError as e:
                error = str(e)
        yield Member(at, name, full, data, error)


def _zip_content(f: BinaryIO, size: int, record: bytes, flags: int, method: int, packed: int, full: int, at: int, most: int) -> bytes:
    if flags & 1:
        raise ExtractError("zip: encrypted")
    if full > most or packed > most + STEP:
        raise ExtractError(f"zip: more than {most} bytes")
    if at + _HEADER > size:
        raise ExtractError("zip: the member lies beyond the archive")
    header = _exactly(f, at, _HEADER, "zip: the member")
    if header[:4] != _LOCAL:
        raise ExtractError("zip: no member where the directory says")
    data = _exactly(f, at + _HEADER + sum(struct.unpack_from("<HH", header, 26)), packed, "zip: the member")
    try:
        if method == 8:
            one = zlib.decompressobj(-15)
            data = one.decompress(data, most + 1)
            if len(data) <= most and not one.eof:
                raise ExtractError("zip: the member is cut off")
        elif method == 12:
            data = bz2.BZ2Decompressor().decompress(data, most + 1)
        elif method:
            raise ExtractError(f"zip: method {method}")
    except (zlib.error, OSError, ValueError, lzma.LZMAError) as e:
        if isinstance(e, ExtractError):
            raise
        raise ExtractError(f"zip: {e}") from e
    if len(data) > most:
        raise ExtractError(f"zip: more than {most} bytes")
    if zlib.crc32(data) != struct.unpack_from("<I", record, 16)[0]:
        raise ExtractError("zip: the checksum differs")
    return data


# -- tar -----------------------------------------------------------------------------------------------------------------


def tar_chain(f: BinaryIO, first: int, end: int) -> Iterator[tuple[int, int, tarfile.TarInfo, tarfile.TarFile]]:
    """Offset, next offset and header of each member that starts in [first, end); extended headers belong to the member after them.

    The next offset is ``END`` where the archive ends.
    """
    archive = tarfile.TarFile(fileobj=io.BytesIO(bytes(2 * BLOCK)), mode="r")
    archive.fileobj = f

    def header(at: int) -> tarfile.TarInfo | None:
        f.seek(at)
        archive.offset = at
        try:
            return tarfile.TarInfo.fromtarfile(archive)
        except (tarfile.EOFHeaderError, tarfile.EmptyHeaderError):
            return None
        except (tarfile.TarError, ValueError, OverflowError) as e:
            raise Damaged(at, f"tar: {e}") from e

    at, member = first, header(first)
    while member is not None:
        after, following, failed = archive.offset, None, None
        if after < end:
            try:
                following = header(after)
            except Damaged as e:
                failed = e
        resume = archive.offset
        yield at, END if after < end and following is None and failed is None else after, member, archive
        if failed:
            raise failed
        archive.offset = resume
        at, member = after, following


def tar_members(f: BinaryIO, first: int, end: int, most: int, content: bool = True) -> Iterator[Member]:
    """Regular files that start in [first, end)."""
    for at, _, m, archive in tar_chain(f, first, end):
        if not m.isreg():
            continue
        data, error = None, None
        if content and m.size > most:
            error = f"tar: more than {most} bytes"
        elif content:
            try:
                data = archive.extractfile(m).read()
            except tarfile.TarError as e:
                error = f"tar: {e}"
        yield Member(at, m.name, m.size, data, error)


def _headers(blocks: np.ndarray) -> np.ndarray:
    """Which blocks have the checksum of a header."""
    field = blocks[:, 148:156]
    totals = blocks.sum(1, dtype=np.int64) - field.sum(1, dtype=np.int64) + 8 * 32
    out = []
    for i in np.flatnonzero((blocks[:, 0] > 0) & ((field >= 48) & (field < 56)).any(1)):
        digits = field[i].tobytes().strip(b" \0").split(b"\0")[0].strip()
        out.append(bool(digits) and digits.isdigit() and not set(digits) & set(b"89") and int(digits, 8) == totals[i] and i)
    return np.array([i for i in out if i is not False], np.int64)


def tar_guess(f: BinaryIO, first: int, end: int) -> tuple[int, int] | None:
    """The first header of a range from which the chain goes to the range's end, and where it goes on.

    A guess: what looks like a header may be part of a member, such as a tar within the tar.
    """
    for at in range(first, end, STEP):
        f.seek(at)
        data = f.read(min(STEP, end - at))
        for i in _headers(np.frombuffer(data, np.uint8, len(data) // BLOCK * BLOCK).reshape(-1, BLOCK)).tolist():
            try:
                after = None
                for _, after, _, _ in tar_chain(f, at + i * BLOCK, end):
                    pass
                if after is not None:
                    return at + i * BLOCK, after
            except Damaged:
                continue
    return None


def tar_parts(f: BinaryIO, size: int, guesses: dict[int, tuple[int, int]], part_bytes: int) -> list[tuple[int, int]]:
    """Parts (first header, end of range) of a tar from what ranges of ``part_bytes`` guessed, keyed by the range's start.

    A guess is right if the chain of the ranges before comes to its header. Where it does not, the headers of that range alone are
    followed here, so the parts are exact whatever was guessed.
    """
    parts, at = [], 0
    for start in range(0, size, part_bytes):
        end = start + part_bytes
        if at == END:
            break
        if at >= end:
            continue
        parts.append((at, end))
        guess = guesses.get(start)
        if guess and guess[0] == at:
            at = guess[1]
            continue
        try:
            after = END
            for _, after, _, _ in tar_chain(f, at, end):
                pass
            at = after
        except Damaged:
            break  # whoever reads this part meets the damage and tells it
    return parts
