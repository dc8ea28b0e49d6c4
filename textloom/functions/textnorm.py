"""Text normalisation: the same rules as Catalyst expressions and as Python functions."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes. White space is spelled out, since engines differ about it.
INVISIBLE = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]"
INVISIBLE_MARKDOWN = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{FEFF}]"
SPACES = r"[\t\n\f\r \x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPACES_MARKDOWN = r"[\t\f\x{0B}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+"
WHITE_SPACE = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


_INVISIBLE, _INVISIBLE_MD, _SPACES, _SPACES_MD, _WHITE = map(_python, (INVISIBLE, INVISIBLE_MARKDOWN, SPACES, SPACES_MARKDOWN, WHITE_SPACE))
_TRIM = re.compile(rf"\A(?:{_WHITE.pattern})|(?:{_WHITE.pattern})\Z")


_WHITE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if _WHITE.fullmatch(c))


def strip_invisible(text: Column, markdown: bool = False) -> Column:
    return F.regexp_replace(text, INVISIBLE_MARKDOWN if markdown else INVISIBLE, "")


def collapse_ws(text: Column, markdown: bool = False) -> Column:
    # a single space stays as it is: most white space is, and each match costs
    white = (SPACES_MARKDOWN if markdown else SPACES).removesuffix("+")
    other = white.replace(" ", "")
    return F.regexp_replace(text, rf"(?:{other}| (?={white})){white}*+" if not markdown else rf"{white}{{2,}}|(?! ){white}", " ")


def collapse_newlines(text: Column, to: str = " ") -> Column:
    return F.regexp_replace(text, r"\n+", to)


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's own trim takes spaces only."""
    return F.trim(text, F.lit(_WHITE_CHARACTERS))


def clean_line(text: Column) -> Column:
    """CR LF and CR are LF, ASCII white space is one space, ends are trimmed."""
    return trim_space(F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"[\t\n\f\r ]+", " "))


def printable_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E\n\r]", "")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


#: HTML's names of characters, from the standard library; those without a semicolon may stand in front of other letters.
_NAMES = html5
_SHORT = sorted((n for n in _NAMES if not n.endswith(";")), key=len, reverse=True)
#: What may follow an ampersand: a number, or up to 32 characters that may be a name.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <#;]{1,32};?)"
_CLOSED = _REFERENCE.replace(";?", ";")
_PY_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{0,31});")


#: Parts of a table; most hold no entry or one.
_PARTS = 8192


def _looked_up(key: Column, entries: dict[str, str]) -> Column:
    """The value of a key, or null, by a table in parts by the hash of the key, so that a look-up meets few entries."""
    parts: list[dict[str, str]] = [{} for _ in range(_PARTS)]
    for k, v in entries.items():
        parts[crc32(k.encode()) % _PARTS][k] = v
    # one literal, which the optimizer reads once
    table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return F.get(table, (F.crc32(key.cast("binary")) % _PARTS).cast("int"))[key]


def _named(name: Column) -> Column:
    """The characters of a name, or null."""
    return _looked_up(name, _NAMES)


def code_point(n: Column) -> Column:
    """The character of a code point; Spark's own ``char`` knows 256."""
    mark = F.lit("﻿")
    return F.when(n == 0xFEFF, mark).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _numbered(name: Column) -> Column:
    """The character that a number stands for, by HTML's rules for what is no character."""
    is_hex = F.substring(name, 2, 1).isin("x", "X")
    written = F.when(is_hex, F.substring(name, 3, 40)).otherwise(F.substring(name, 2, 40))
    digits = F.ltrim(F.rtrim(written, F.lit(";")), F.lit("0"))

    def value(d: Column) -> Column:
        # longer numbers are beyond Unicode
        known = F.when(is_hex & (F.length(d) <= 6), F.conv(d, 16, 10).cast("int")).when(~is_hex & (F.length(d) <= 7), d.cast("int"))
        return F.when(d == "", 0).otherwise(F.coalesce(known, F.lit(0x110000)))

    return let(let(digits, value), _character)


def let(x: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(x), use)[0]


def _character(n: Column) -> Column:
    # numbers of 128 to 159 mean the code page of old Windows
    old = {i: bytes([i]).decode("cp1252", "replace").replace("�", chr(i)) for i in range(128, 160)}
    windows = F.array(*(F.lit(old[i]) for i in sorted(old)))
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    broken = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(broken, "�").when(n.between(128, 159), F.get(windows, n - 128)).when(nothing, "").otherwise(code_point(n))


def _replaced(name: Column, bare: bool) -> Column:
    """What a possible reference (without its ampersand) stands for, or null."""
    if not bare:
        return F.when(F.startswith(name, F.lit("#")), _numbered(name)).otherwise(_named(name))
    short = F.regexp_extract(name, "^(?:" + "|".join(_SHORT) + ")", 0)
    in_front = let(short, lambda s: F.when(s != "", F.concat(_named(s), F.substring(name, F.length(s) + 1, F.length(name)))))
    return F.when(F.startswith(name, F.lit("#")), _numbered(name)).otherwise(F.coalesce(_named(name), in_front))


def unescape(text: Column, bare: bool = True) -> Column:
    """All character references of HTML, named and numbered, decoded once, by expressions.

    A text is split at its ampersands; what follows one is looked up whole, then, as HTML says, by the longest name at its
    start that needs no semicolon. What is no reference stays; if not ``bare``, so does one without its semicolon.
    """
    return let(text, lambda t: _unescaped(t, bare))


def _unescaped(text: Column, bare: bool) -> Column:
    # functions of elements are interpreted: the usual references take few steps, without ``let``, whose type is worked out at each use
    pieces = F.transform(F.split(text, "&"), lambda p: F.struct(p.alias("piece"), F.substring_index(p, ";", 1).alias("name")))
    usual = lambda x: F.concat(_usual(x), F.substr(x["piece"], F.length(x["name"]) + 2))
    out = F.transform(pieces, lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.coalesce(usual(x), _any(x["piece"], bare))))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(out, ""))


#: Names, and the numbers of the first letters, all without the semicolon that ends them.
_USUAL = {k.removesuffix(";"): v for k, v in _NAMES.items() if k.endswith(";")} | {w: html.unescape(f"&{w};") for n in range(768) for w in (f"#{n}", f"#x{n:x}", f"#x{n:X}")}
#: Other numbers that are characters of one unit.
_HEX = r"\A#[xX](?:0[1-9a-fA-F]|[1-9a-cA-C][0-9a-fA-F]|[dD][0-7])[0-9a-fA-F]{2}\z"
_DECIMAL = r"\A#(?:[3-9][0-9]{2}|[1-9][0-9]{3}|[1-4][0-9]{4}|5[0-4][0-9]{3})\z"


def _usual(x: Column) -> Column:
    """The value of the name or number that a piece begins with up to its semicolon; null for some that are rare and for all that is no such reference."""
    name = x["name"]
    unit = F.when(F.rlike(name, F.lit(_HEX)), F.substring(name, 3, 4)).when(F.rlike(name, F.lit(_DECIMAL)), F.lpad(F.hex(F.substring(name, 2, 5).cast("bigint")), 4, "0"))
    numbered = F.when(F.startswith(name, F.lit("#")), F.decode(F.unhex(unit), "UTF-16BE"))
    return F.when(F.contains(x["piece"], F.lit(";")), F.coalesce(_looked_up(name, _USUAL), numbered))


def _any(piece: Column, bare: bool) -> Column:
    """Any piece, decoded if a reference stands at its start."""

    def decoded(name: Column) -> Column:
        value = F.when(name != "", _replaced(name, bare))
        return F.coalesce(F.concat(value, F.substring(piece, F.length(name) + 1, F.length(piece))), F.concat(F.lit("&"), piece))

    return let(F.regexp_extract(piece, _REFERENCE if bare else _CLOSED, 0), decoded)


def py_unescape(text: str, bare: bool = True) -> str:
    return html.unescape(text) if bare else _PY_CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in _NAMES else m[0], text)


def py_strip_invisible(text: str, markdown: bool = False) -> str:
    return (_INVISIBLE_MD if markdown else _INVISIBLE).sub("", text)


def py_collapse_ws(text: str, markdown: bool = False) -> str:
    return (_SPACES_MD if markdown else _SPACES).sub(" ", text)


def py_trim_space(text: str) -> str:
    return _TRIM.sub("", text)


def py_clean_line(text: str) -> str:
    return py_trim_space(re.sub(r"[\t\n\f\r ]+", " ", text))
