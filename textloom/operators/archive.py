"""Archives: entries in walk order, nested archives to a depth, and the folded text of all of them.

Each file is a header line with its path, its text and a blank line. Entries are ordered by the parts of their paths, as a
walk through folders would meet them. What cannot be read is an error of its entry, unless ``fail_fast``. Where an archive is damaged
or goes beyond a limit, what has been read stays, and an entry of the empty path tells the error.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from textloom.functions import filetypes
from textloom.functions.paths import py_sanitize_path

from . import rar, sevenzip
from .result import ExtractError, LimitError, Limits, Result
from .zipped import Container

#: The block of an entry, and names for what has none.
BLOCK = "=== 文件名: /{} ===\n\n{}\n\n"
DEFAULT_TAR, DEFAULT_TEXT = "default_gz_file_name.tar", "default_gz_file_name.txt"
KINDS = ("zip", "tar", "gz", "bz2", "xz", "7z", "rar")


@dataclass
class Entry:
    """A file in an archive; ``path`` has a part for each level of nesting."""

    path: tuple[str, ...]
    file_type: int
    text: str
    method: str
    error: str | None


def _expand(unpack, data: bytes, limit: int, kind: str) -> tuple[bytes, str | None]:
    """All members of a compressed stream up to a limit, and what ended it early."""
    out = bytearray()
    try:
        while data:
            one = unpack()
            out += one.decompress(data, limit + 1 - len(out))
            if len(out) > limit:
                return bytes(out[:limit]), f"{kind}: expands beyond the limit"
            if not one.eof:
                return bytes(out), f"{kind}: the stream is cut off"
            data = one.unused_data.lstrip(b"\0") if kind != "bz2" else one.unused_data
            if data and not out:
                break
    except (zlib.error, lzma.LZMAError, OSError, EOFError) as e:
        if not out:
            raise ExtractError(f"{kind}: {e}") from e
        return bytes(out), f"{kind}: {e}"
    return bytes(out), None


def _gzip_name(data: bytes) -> str:
    if data[:2] != b"\x1f\x8b" or len(data) < 10:
        raise ExtractError("gz: no signature")
    flags, at = data[3], 10
    if flags & 4 and at + 2 <= len(data):
        at += 2 + struct.unpack_from("<H", data, at)[0]
    return data[at : data.find(b"\0", at)].decode("latin-1") if flags & 8 else ""


def _without(name: str, suffix: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base[: -len(suffix)] if base.lower().endswith(suffix) and len(base) > len(suffix) else base


def files(kind: str, data: bytes, name: str, limits: Limits) -> tuple[list[tuple[str, bytes, str | None]], str | None]:
    """Sanitized path, content and error of each file, and what ended the reading early; a later file of the same path replaces the
    earlier one."""
    found: list[tuple[str, bytes, str | None]] = []
    stop = None
    if kind == "zip":
        box = Container(data, limits)
        for n in box.names():
            if len(found) >= limits.entries:
                stop = "zip: too many entries"
                break
            try:
                found.append((n, box.read(n), None))
            except LimitError as e:
                stop = str(e)
                break
            except ExtractError as e:
                found.append((n, b"", str(e)))
    elif kind == "tar":
        left = limits.expanded_bytes
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for m in t:
                    if len(found) >= limits.entries:
                        stop = "tar: too many entries"
                        break
                    if m.isreg():
                        left -= m.size
                        if left < 0:
                            stop = "tar: expands beyond the limit"
                            break
                        found.append((m.name, t.extractfile(m).read(), None))
        except (tarfile.TarError, EOFError, ValueError) as e:
            if not found:
                raise ExtractError(f"tar: {e}") from e
            stop = f"tar: {e}"
    elif kind == "gz":
        inner = _gzip_name(data) or (DEFAULT_TAR if name.lower().endswith("tar.gz") else DEFAULT_TEXT)
        raw, stop = _expand(lambda: zlib.decompressobj(31), data, limits.expanded_bytes, "gz")
        found.append((inner, raw, None))
    elif kind == "bz2":
        raw, stop = _expand(bz2.BZ2Decompressor, data, limits.expanded_bytes, "bz2")
        found.append((_without(name, ".bz2"), raw, None))
    elif kind == "xz":
        raw, stop = _expand(lambda: lzma.LZMADecompressor(memlimit=1 << 30), data, limits.expanded_bytes, "xz")
        found.append((_without(name, ".xz"), raw, None))
    elif kind == "7z":
        try:
            for n, raw in rar_entries(data) if data.startswith(b"Rar!") else sevenzip.entries(data, limits):
                found.append((n, raw, None))
        except ExtractError as e:
            if not found:
                raise
            stop = str(e)
    elif kind == "rar":
        found += rar.entries(data)
    else:
        raise ExtractError(f"no archive: {kind}")
    return [(p, raw, e) for p, (raw, e) in {py_sanitize_path(n): (raw, e) for n, raw, e in found}.items() if p], stop


def rar_entries(data: bytes) -> list[tuple[str, bytes]]:
    return [(n, raw) for n, raw, _ in rar.entries(data)]


def _ordered(found):
    return sorted(found, key=lambda x: x[0].split("/"))


@dataclass
class _Rest:
    """What all levels of an archive may still expand to and hold together."""

    expanded_bytes: int
    entries: int


def walk(kind: str, data: bytes, name: str, extract, limits: Limits = Limits(), fail_fast: bool = False, above: tuple[str, ...] = (), rest: _Rest | None = None) -> Iterator[Entry]:
    """Leaves of an archive and of those in it, in walk order. ``extract`` takes (type, bytes, name).

    The limits hold for all levels together: what one inner archive expands to is not there for the next.
    """
    if len(above) >= limits.depth:
        raise LimitError("archives are nested too deeply")
    rest = rest or _Rest(limits.expanded_bytes, limits.entries)
    try:
        found, stop = files(kind, data, name, Limits(limits.depth, rest.expanded_bytes, rest.entries))
    except ExtractError:
        raise
    except Exception as e:  # damaged or hostile bytes fail in many ways
        raise ExtractError(f"{kind}: {type(e).__name__}: {e}") from e
    rest.expanded_bytes -= sum(len(raw) for _, raw, _ in found)
    rest.entries -= len(found)
    for path, raw, error in _ordered(found):
        code = filetypes.detect(path)
        inner = filetypes.EXTRACTORS.get(code)
        if error is None and inner in KINDS:
            try:
                yield from walk(inner, raw, path, extract, limits, fail_fast, (*above, path), rest)
                continue
            except ExtractError as e:
                error = str(e)
        if error is None:
            try:
                r = extract(code, raw, path)
                yield Entry((*above, path), code, r.text, r.method, r.error)
                continue
            except ExtractError as e:
                error = str(e)
        if fail_fast:
            raise ExtractError(f"{path}: {error}")
        yield Entry((*above, path), code, "", inner or "raw", error)
    if stop and fail_fast:
        raise ExtractError(stop)
    if stop:
        yield Entry((*above, ""), filetypes.UNKNOWN, "", kind, stop)


def fold(entries: list[Entry], depth: int = 0) -> str:
    """The text of an archive: a block for each file, the folded text of an inner archive being its text."""
    out, i = [], 0
    entries = [e for e in entries if e.path[-1] or len(e.path) > depth + 1]
    while i < len(entries):
        e = entries[i]
        if len(e.path) == depth + 1:
            out.append(BLOCK.format(e.path[depth], e.text))
            i += 1
            continue
        k = i
        while k < len(entries) and len(entries[k].path) > depth + 1 and entries[k].path[: depth + 1] == e.path[: depth + 1]:
            k += 1
        out.append(BLOCK.format(e.path[depth], fold(entries[i:k], depth + 1)))
        i = k
    return "".join(out)


def extract_archive(kind: str, data: bytes, name: str, extract, limits: Limits = Limits(), fail_fast: bool = False) -> Result:
    found = list(walk(kind, data, name, extract, limits, fail_fast))
    errors = [f"{'!'.join(filter(None, e.path))}: {e.error}" if any(e.path) else e.error for e in found if e.error]
    return Result(fold(found), kind, [("!".join(e.path), e.text) for e in found if e.path[-1]], "; ".join(errors) or None)


__all__ = ["Entry", "extract_archive", "files", "fold", "walk"]
