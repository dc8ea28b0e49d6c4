"""What an extractor returns."""

from __future__ import annotations

from dataclasses import dataclass, field


class ExtractError(ValueError):
    """The bytes are not what their type says, or go beyond a limit."""


class LimitError(ExtractError):
    """What was asked for goes beyond a limit."""


@dataclass
class Result:
    """Text of a document, the way it was found, and its parts (pages, sheets, slides, entries)."""

    text: str
    method: str
    parts: list[tuple[str, str]] = field(default_factory=list)
    error: str | None = None


@dataclass(frozen=True)
class Limits:
    """What nested and compressed input may grow to; what goes beyond is an error of its entry."""

    depth: int = 8
    expanded_bytes: int = 256 << 20
    entries: int = 10_000
