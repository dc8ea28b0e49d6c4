"""Rich text: words outside destinations that hold no text, as one line."""

from __future__ import annotations

import re

from textloom.functions import textnorm

from .result import ExtractError, Result

#: Destinations whose groups are not text.
DESTINATIONS = (
    "fonttbl colortbl styltbl listtbl pict table info revtbl stylesheet filetable parfmt listlevel pagetbl shppict nonshppict field formfield "
    "listtable pgptbl rsidtable author operator themedata datastore objdata lsdlocked xmlnstbl ud upr xe urtfN userprops vern version ts tsrowd "
    "tscell wbitmap wmetafile"
).split()
_SKIPPED = frozenset(DESTINATIONS)
#: Control words that stand for characters.
_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(rb"\\([A-Za-z]{1,32})(-?\d{1,10})? ?|\\'([0-9A-Fa-f]{2})|\\([^A-Za-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def positions(data: bytes) -> list[tuple[int, int, str]]:
    """Offset and length in the text's UTF-8, and text, of each run between control words that breaks it."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ExtractError("no RTF header")
    stack: list[tuple[bool, int]] = []
    skip, unicode_skip, left, codepage, first, star = False, 1, 0, "cp1252", False, False
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    raw = bytearray()
    at = 0

    def decode():
        if raw:
            held.append(raw.decode(codepage, "replace"))
            raw.clear()

    def flush():
        nonlocal at
        decode()
        text = "".join(held)
        held.clear()
        if text:
            size = len(text.encode("utf-8", "surrogatepass"))
            out.append((at, size, text))
            at += size

    def put(text: str):
        decode()
        held.append(text)

    skip_to = -1
    for m in _TOKEN.finditer(data):
        if m.start() < skip_to:
            continue
        word, number, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append((skip, unicode_skip))
            first, star, left = True, False, 0
            continue
        if brace == b"}":
            if stack:
                was, unicode_skip = stack.pop()
                if was != skip:
                    flush()
                skip = was
            first = star = False
            left = 0
            continue
        if word is not None:
            name = word.decode()
            if name == "bin":
                skip_to = m.end() + max(0, int(number or 0))
            elif name == "uc":
                unicode_skip = max(0, int(number or 1))
            elif name == "ansicpg" and number:
                try:
                    b"".decode(f"cp{int(number)}")
                    codepage = f"cp{int(number)}"
                except LookupError:
                    pass
            elif first and (star or name in _SKIPPED):
                skip = True
            elif not skip and name == "u" and number:
                put(chr(int(number) & 0xFFFF))
                left = unicode_skip
            elif not skip and name in _SIGNS:
                put(_SIGNS[name])
                if _SIGNS[name] == "\n":
                    flush()
            first = False
            continue
        if symbol == b"*" and first:
            star = True
            continue
        first = False
        if skip:
            continue
        if code is not None:
            if left:
                left -= 1
            else:
                raw.append(int(code, 16))
        elif symbol is not None:
            text = {b"~": "\u00a0", b"_": "\u2011", b"-": "", b"\n": "\n", b"\r": "\n"}.get(symbol, symbol.decode("latin-1") if symbol in b"\\{}" else "")
            put(text)
        elif plain is not None:
            if left:
                plain, left = plain[left:], max(0, left - len(plain))
            raw += plain
    flush()
    return out


def extract_rtf(data: bytes, name: str = "") -> Result:
    found = positions(data)
    text = "".join(t for _, _, t in found).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return Result(textnorm.py_clean_line(text), "rtf", [(f"{offset}+{size}", t) for offset, size, t in found])
