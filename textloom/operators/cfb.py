"""OLE compound files: a directory of streams over sector chains, read with guards against cycles."""

from __future__ import annotations

import struct

from .result import ExtractError

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST = 0xFFFFFFFA  # this and what is above are no sectors


class CompoundFile:
    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != SIGNATURE:
            raise ExtractError("no compound file")
        self.data = data
        self.version, shift, mini_shift = struct.unpack_from("<H2xHH", data, 26)
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            raise ExtractError("compound file: bad sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.cutoff, mini_first, _, difat, n_difat = struct.unpack_from("<I4xIIIII", data, 48)
        table = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while difat < _LAST and difat not in seen and len(seen) <= n_difat:
            seen.add(difat)
            some = self._numbers(self._sector(difat))
            table += some[:-1]
            difat = some[-1]
        self.fat: list[int] = []
        for s in table:
            if s < _LAST:
                self.fat += self._numbers(self._sector(s))
        raw = self._chain(directory)
        self.entries = [e for i in range(0, len(raw) - 127, 128) if (e := self._entry(raw[i : i + 128]))]
        self.mini_fat = self._numbers(self._chain(mini_first)) if mini_first < _LAST else []
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini = self._chain(root[2])[: root[3]] if root and root[2] < _LAST else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size]

    def _numbers(self, raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, first: int) -> bytes:
        out, seen = [], set()
        while first < _LAST:
            if first in seen:
                raise ExtractError("compound file: a chain of sectors runs in a circle")
            if first >= len(self.fat):
                raise ExtractError("compound file: a sector is not in the table")
            seen.add(first)
            out.append(self._sector(first))
            first = self.fat[first]
        return b"".join(out)

    def _entry(self, raw: bytes) -> tuple[str, int, int, int] | None:
        length, kind = struct.unpack_from("<HB", raw, 64)
        if kind not in (1, 2, 5):
            return None
        first, size = struct.unpack_from("<IQ", raw, 116)
        return raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, first, size & 0xFFFFFFFF if self.version == 3 else size

    def stream(self, *names: str) -> bytes:
        """The content of the first stream that has one of the names."""
        for wanted in names:
            for name, kind, first, size in self.entries:
                if kind == 2 and name.lower() == wanted.lower():
                    if size >= self.cutoff or not self.mini_fat:
                        return self._chain(first)[:size]
                    out, seen = [], set()
                    while first < _LAST and first < len(self.mini_fat):
                        if first in seen:
                            raise ExtractError("compound file: a chain of sectors runs in a circle")
                        seen.add(first)
                        out.append(self.mini[first * self.mini_size : (first + 1) * self.mini_size])
                        first = self.mini_fat[first]
                    return b"".join(out)[:size]
        raise ExtractError(f"compound file: no stream {' or '.join(names)}")
