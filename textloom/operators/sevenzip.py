"""7z archives: headers of folders and files, and raw coder chains of the standard library's LZMA."""

from __future__ import annotations

from collections.abc import Iterator

import bz2
import lzma
import struct
import zlib

from .result import ExtractError, Limits

SIGNATURE = b"7z\xbc\xaf\x27\x1c"
#: Coder ids.
_FILTERS = {b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x03\x03\x04\x01": lzma.FILTER_IA64, b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC}
END, HEADER, STREAMS, FILES, PACK, UNPACK, SUB, SIZE, CRC, FOLDER, CODERS, N_STREAMS, EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 23


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ExtractError("7z: a header is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, value, mask = self.byte(), 0, 0x80
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > 10_000_000:
            raise ExtractError("7z: too many entries")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


def _streams(r: _Reader) -> dict:
    out = {"start": 0, "packed": [], "folders": [], "counts": None, "sizes": None}
    while (kind := r.byte()) != END:
        if kind == PACK:
            out["start"], n = r.number(), r.count()
            while (k := r.byte()) != END:
                if k == SIZE:
                    out["packed"] = [r.number() for _ in range(n)]
                elif k == CRC:
                    r.take(4 * sum(r.defined(n)))
        elif kind == UNPACK:
            if r.byte() != FOLDER:
                raise ExtractError("7z: no folders")
            n = r.count()
            if r.byte():
                raise ExtractError("7z: folders elsewhere")
            out["folders"] = [_folder(r) for _ in range(n)]
            if r.byte() != CODERS:
                raise ExtractError("7z: no sizes of folders")
            for f in out["folders"]:
                f["sizes"] = [r.number() for _ in range(f["n_out"])]
            while (k := r.byte()) != END:
                if k == CRC:
                    r.take(4 * sum(r.defined(n)))
        elif kind == SUB:
            counts = [1] * len(out["folders"])
            k = r.byte()
            if k == N_STREAMS:
                counts = [r.count() for _ in counts]
                k = r.byte()
            sizes = []
            for c, f in zip(counts, out["folders"], strict=True):
                known = [r.number() for _ in range(c - 1)] if k == SIZE and c else []
                sizes.append([*known, _size(f) - sum(known)] if c else [])
            out["counts"], out["sizes"] = counts, sizes
            if k == SIZE:
                k = r.byte()
            while k != END:
                if k == CRC:
                    r.take(4 * sum(r.defined(sum(counts))))  # no folder's own sum is kept above
                k = r.byte()
    if out["counts"] is None:
        out["counts"], out["sizes"] = [1] * len(out["folders"]), [[_size(f)] for f in out["folders"]]
    return out


def _folder(r: _Reader) -> dict:
    coders, n_in, n_out = [], 0, 0
    for _ in range(r.count()):
        flags = r.byte()
        kind = r.take(flags & 15)
        ins, outs = (r.count(), r.count()) if flags & 16 else (1, 1)
        properties = r.take(r.count()) if flags & 32 else b""
        if ins != 1 or outs != 1:
            raise ExtractError("7z: coders with several streams are not supported")
        coders.append((kind, properties))
        n_in, n_out = n_in + ins, n_out + outs
    bonds = [(r.count(), r.count()) for _ in range(n_out - 1)]
    packed = n_in - len(bonds)
    if packed > 1:
        for _ in range(packed):
            r.count()
    return {"coders": coders, "bonds": bonds, "n_out": n_out, "packed": packed, "sizes": []}


def _size(folder: dict) -> int:
    bound = {o for _, o in folder["bonds"]}
    return next(folder["sizes"][i] for i in range(folder["n_out"]) if i not in bound)


def _unpacked(folder: dict, raw: bytes, limit: int) -> bytes:
    if any(s > limit for s in folder["sizes"]):
        raise ExtractError("7z: expands beyond the limit")
    feeds = {i: o for i, o in folder["bonds"]}  # the input of a coder is the output of another
    order = [next(i for i in range(len(folder["coders"])) if i not in feeds)]
    by_out = {o: i for i, o in folder["bonds"]}
    while order[-1] in by_out:
        order.append(by_out[order[-1]])
    for i in order:
        kind, p = folder["coders"][i]
        raw = _decoded(kind, p, raw, folder["sizes"][i])
    return raw


def _decoded(kind: bytes, p: bytes, raw: bytes, size: int) -> bytes:
    try:
        if kind == b"\x00":
            return raw[:size]
        if kind == b"\x03\x01\x01":
            d, dictionary = p[0], struct.unpack_from("<I", p, 1)[0]
            f = {"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(4096, dictionary)}
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[f]).decompress(raw, size)
        if kind == b"\x21":
            dictionary = 0xFFFFFFFF if p[0] >= 40 else (2 | p[0] & 1) << p[0] // 2 + 11
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": min(dictionary, 1 << 30)}]).decompress(raw, size)
        if kind == b"\x03":
            distance, out = p[0] + 1, bytearray(raw)
            for i in range(distance, len(out)):
                out[i] = out[i] + out[i - distance] & 255
            return bytes(out)
        if kind in _FILTERS:
            # a branch filter runs only at the end of a chain with LZMA2, so the bytes are wrapped as stored chunks
            chunks = b"".join(bytes([1 if i == 0 else 2]) + struct.pack(">H", len(raw[i : i + 65536]) - 1) + raw[i : i + 65536] for i in range(0, len(raw), 65536)) + b"\0"
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": _FILTERS[kind]}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]).decompress(chunks, size)
        if kind == b"\x04\x01\x08":
            return zlib.decompressobj(-15).decompress(raw, size)
        if kind == b"\x04\x02\x02":
            return bz2.BZ2Decompressor().decompress(raw, size)
    except (lzma.LZMAError, zlib.error, OSError, struct.error, IndexError, EOFError, MemoryError) as e:
        raise ExtractError(f"7z: {e}") from e
    raise ExtractError(f"7z: coder {kind.hex()} is not supported")


def entries(data: bytes, limits: Limits = Limits()) -> Iterator[tuple[str, bytes]]:
    """Names and content of the files of an archive."""
    if data[:6] != SIGNATURE or len(data) < 32:
        raise ExtractError("no 7z signature")
    offset, size = struct.unpack_from("<QQ", data, 12)
    if not size:
        return []
    r, left = _Reader(data[32 + offset : 32 + offset + size]), limits.expanded_bytes
    kind = r.byte()
    while kind == ENCODED:
        s = _streams(r)
        start = 32 + s["start"]
        r = _Reader(_unpacked(s["folders"][0], data[start : start + s["packed"][0]], left))
        kind = r.byte()
    if kind != HEADER:
        raise ExtractError("7z: no header")
    streams, names, empty, empty_file = None, [], [], []
    while (kind := r.byte()) != END:
        if kind == STREAMS:
            streams = _streams(r)
        elif kind == FILES:
            n = r.count()
            if n > limits.entries:
                raise ExtractError("7z: too many entries")
            empty = [False] * n
            while (k := r.byte()) != END:
                body = _Reader(r.take(r.number()))
                if k == EMPTY_STREAM:
                    empty = body.bits(n)
                elif k == EMPTY_FILE:
                    empty_file = body.bits(sum(empty))
                elif k == NAMES:
                    body.byte()
                    names = body.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
        else:
            r.take(r.number())
    contents: list[bytes] = []
    stop = None
    if streams:
        at, packed = 32 + streams["start"], iter(streams["packed"])
        for folder, sizes in zip(streams["folders"], streams["sizes"], strict=True):
            if folder["packed"] != 1:
                raise ExtractError("7z: folders with several packed streams are not supported")
            raw_size = next(packed)
            try:
                out = _unpacked(folder, data[at : at + raw_size], left)
            except ExtractError as e:
                stop = e
                break
            left -= len(out)
            at += raw_size
            start = 0
            for s in sizes:
                contents.append(out[start : start + s])
                start += s
    full, blank = iter(contents), iter(empty_file)
    for name, none in zip(names, empty, strict=False):
        if not none:
            content = next(full, None)
            if content is not None or not stop:
                yield name, content or b""
        elif next(blank, False):
            yield name, b""
    if stop:
        raise stop
