"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BASE = _U(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that are hashed in one go.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODES = mix(np.arange(1, 257, dtype=_U) * _BASE)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word (run of bytes other than space and 09-0D; A-Z folded)."""
    inside = ~_SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, _U)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(at)) - np.repeat(first, lengths)
    powers = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
    values = _CODES[_FOLD[data[at]]] * powers[within]
    return starts, mix(np.add.reduceat(values, first) + lengths.astype(_U))


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space where there is some."""
    at = 0
    while len(text) - at > CHUNK:
        to = max(text.rfind(sep, at + 1, at + CHUNK) for sep in (b" ", b"\n", b"\t"))
        if to <= at:
            rest = [x for sep in (b" ", b"\n", b"\t") if (x := text.find(sep, at + 1)) > 0]
            to = min(rest, default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    n, m = len(words), min(k, len(words))
    total = np.full(n - m + 1, m * int(_BASE) & 0xFFFFFFFFFFFFFFFF, _U)
    for j in range(m):
        total += words[j : n - m + 1 + j] * _powers(j + 2)[j + 1]
    return mix(total)


def sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """For each text its ascending distinct shingle hashes; fewer than k words are one shingle."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        if group:
            data = np.frombuffer(b" ".join(group), np.uint8)
            starts, words = word_hashes(data)
            bounds = np.cumsum([0, *(len(g) + 1 for g in group)])
            cuts = np.searchsorted(starts, bounds)
            if len(words) >= k:
                every = _shingles(words, k)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(np.unique(every[a : b - k + 1]) if b - a >= k else _shingles(words[a:b], k) if b > a else np.zeros(0, _U))
            group.clear()

    for t in texts:
        t = t or b""
        if len(t) > CHUNK:
            flush()
            size = 0
            words = np.concatenate([word_hashes(np.frombuffer(p, np.uint8))[1] for p in _pieces(t)])
            out.append(np.unique(_shingles(words, k)) if len(words) else words)
            continue
        if size + len(t) > CHUNK:
            flush()
            size = 0
        group.append(t)
        size += len(t)
    flush()
    return out


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit id for a whole set."""
    x = mix(np.concatenate((mix(s ^ _BASE), np.array([len(s)], _U) * _BASE)).sum(dtype=_U, keepdims=True))
    return int(x.view(np.int64)[0])
