"""Markdown: text of a CommonMark subset.

Headings, paragraphs, lists, quotes, code, rules and HTML blocks; emphasis, code spans, links, images and autolinks.
Segments of text are joined by CR LF, and the end of a block is a segment that is a line feed.
"""

from __future__ import annotations

import re

from textloom.functions import textnorm

from .result import Result

_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
#: Names of tags that open an HTML block.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param pre script search section style summary table tbody td textarea tfoot "
    "th thead title tr track ul"
).split()
_HTML = re.compile(rf" {{0,3}}<(?:!--|\?|![A-Za-z]|/?(?:{'|'.join(_BLOCK_TAGS)})(?:[\s/>]|$))", re.I)
_HTML_LINE = re.compile(r"""\s{0,3}</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>\s*$""")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_INDENT = re.compile(r"(?: {4}| {0,3}\t)")
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_INLINE_HTML = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|\?.*?\?)>", re.S)
_LINK_TAIL = re.compile(r"""\(\s*(?:<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)?(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*\)""")
_REFERENCE = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^()]*\)))?[ \t]*$""")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


_BREAK = ("", 0, False, False)  # markup that divides text


class _Block:
    def __init__(self, kind: str, lines: list[str] | None = None, children: list[_Block] | None = None):
        self.kind, self.lines, self.children = kind, lines or [], children or []


def _without_indent(line: str, n: int) -> str:
    line = line.expandtabs(4) if "\t" in line[:n] else line
    spaces = len(line) - len(line.lstrip(" "))
    return line[min(n, spaces) :]


def _starts_block(line: str) -> bool:
    return bool(_RULE.match(line) or _ATX.match(line) or _FENCE.match(line) or line.lstrip(" ").startswith(">") and len(line) - len(line.lstrip(" ")) < 4)


def _parse(lines: list[str], references: set[str], depth: int = 0) -> list[_Block]:
    out: list[_Block] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _INDENT.match(line):
            held = []
            while i < n and (_INDENT.match(lines[i]) or not lines[i].strip()):
                held.append(_without_indent(lines[i], 4))
                i += 1
            while held and not held[-1].strip():
                held.pop()
            out.append(_Block("code", held))
        elif m := _FENCE.match(line):
            held, close = [], re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            i += 1
            while i < n and not close.match(lines[i]):
                held.append(_without_indent(lines[i], len(m[1])))
                i += 1
            i += 1
            out.append(_Block("fence", held))
        elif m := _ATX.match(line):
            out.append(_Block("heading", [m[2] or ""]))
            i += 1
        elif _RULE.match(line):
            out.append(_Block("rule"))
            i += 1
        elif line.lstrip(" ").startswith(">") and depth < 100:
            held = []
            while i < n and lines[i].strip() and (lines[i].lstrip(" ").startswith(">") or held and held[-1].strip() and not _starts_block(lines[i]) and not _ITEM.match(lines[i])):
                held.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(_Block("quote", children=_parse(held, references, depth + 1)))
        elif (m := _ITEM.match(line)) and depth < 100:
            kind, items = m[2][-1], []
            while i < n and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
                width = len(m[0]) if m[3].strip("\t") == m[3] and len(m[3]) <= 4 and lines[i][m.end() :] else len(m[1]) + len(m[2]) + 1
                held = [lines[i][min(width, len(lines[i])) :]]
                i += 1
                while i < n:
                    blank = not lines[i].strip()
                    inside = len(lines[i]) - len(lines[i].lstrip(" ")) >= width or lines[i].startswith("\t")
                    if blank and (i + 1 >= n or not (len(lines[i + 1]) - len(lines[i + 1].lstrip(" ")) >= width)):
                        break
                    lazy = held[-1].strip() and not _starts_block(lines[i]) and not _ITEM.match(lines[i])
                    if not (blank or inside or lazy):
                        break
                    held.append(_without_indent(lines[i], width))
                    i += 1
                items.append(_Block("item", children=_parse(held, references, depth + 1)))
                while i + 1 < n and not lines[i].strip() and (k := _ITEM.match(lines[i + 1])) and k[2][-1] == kind:
                    i += 1
            out.append(_Block("list", children=items))
        elif _HTML.match(line) or _HTML_LINE.match(line):
            while i < n and lines[i].strip():
                i += 1
            out.append(_Block("html"))
        elif m := _REFERENCE.match(line):
            references.add(" ".join(m[1].lower().split()))
            i += 1
        else:
            held = [line.strip()]
            i += 1
            kind = "paragraph"
            while i < n and lines[i].strip():
                if _SETEXT.match(lines[i]):
                    kind = "heading"
                    i += 1
                    break
                m = _ITEM.match(lines[i])
                if _starts_block(lines[i]) or m and lines[i][m.end() :] and not (m[2][0].isdigit() and m[2][:-1] != "1"):
                    break
                held.append(lines[i].strip())
                i += 1
            out.append(_Block(kind, held))
    return out


def _inline(text: str, references: set[str]) -> list[str]:
    """Text segments of a block's inline content: markup divides them, line ends do."""
    pieces: list = []  # strings, and markers [sign, count, opens, closes]
    held: list[str] = []

    def flush():
        if held:
            pieces.append("".join(held))
            held.clear()

    brackets: list[int] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in _PUNCTUATION:
            held.append(text[i : i + 2])
            i += 2
        elif c == "`":
            k = len(text) - i - len(text[i:].lstrip("`"))
            m = re.compile(rf"(?<!`)`{{{k}}}(?!`)").search(text, i + k)
            if m:
                flush()
                inner = text[i + k : m.start()].replace("\n", " ")
                pieces += [_BREAK, inner[1:-1] if inner.strip() and inner[0] == inner[-1] == " " else inner, _BREAK]
                i = m.end()
            else:
                held.append("`" * k)
                i += k
        elif c == "<" and (m := _AUTOLINK.match(text, i) or _INLINE_HTML.match(text, i)):
            flush()
            pieces.append(_BREAK)
            i = m.end()
        elif c in "*_":
            k = i
            while k < n and text[k] == c:
                k += 1
            before, after = text[i - 1] if i else " ", text[k] if k < n else " "
            left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
            right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
            flush()
            opens = left and (c == "*" or not right or before in _PUNCTUATION)
            closes = right and (c == "*" or not left or after in _PUNCTUATION)
            pieces.append([c, k - i, opens, closes])
            i = k
        elif c == "[" or c == "!" and text[i : i + 2] == "![":
            flush()
            brackets.append(len(pieces))
            pieces.append(["[", "![" if c == "!" else "[", False, False])
            i += 2 if c == "!" else 1
        elif c == "]" and brackets:
            at = brackets.pop()
            flush()
            inner = "".join(x if isinstance(x, str) else x[0] * x[1] if x[0] != "[" else x[1] for x in pieces[at + 1 :])
            tail = _LINK_TAIL.match(text, i + 1)
            named = re.compile(r"\[([^\[\]]*)\]").match(text, i + 1)
            if tail:
                i = tail.end()
            elif named and " ".join((named[1] or inner).lower().split()) in references:
                i = named.end()
            elif " ".join(inner.lower().split()) in references:
                i += 1
            else:
                held.append("]")
                i += 1
                continue
            pieces[at] = _BREAK
            pieces.append(_BREAK)
        elif c == "\n":
            if held and held[-1].endswith("\\"):
                held[-1] = held[-1][:-1]
            flush()
            pieces.append(_BREAK)
            i += 1
        else:
            k = i + 1
            while k < n and text[k] not in "\\`<*_[!]\n":
                k += 1
            held.append(text[i:k])
            i = k
    flush()
    openers: list[list] = []
    for x in pieces:
        if isinstance(x, str) or x[0] not in ("*", "_"):
            continue
        if x[3]:
            k = len(openers) - 1
            while k >= 0 and x[1]:
                o = openers[k]
                odd = (x[2] or o[3]) and (x[1] + o[1]) % 3 == 0 and (x[1] % 3 or o[1] % 3)
                if o[0] == x[0] and not odd:
                    used = 2 if o[1] >= 2 and x[1] >= 2 else 1
                    o[1] -= used
                    x[1] -= used
                    del openers[k + 1 :]
                    if not o[1]:
                        openers.pop()
                        k -= 1
                    continue
                k -= 1
        if x[2] and x[1]:
            openers.append(x)
    out: list[str] = []
    joined = False
    for x in pieces:
        if isinstance(x, str):
            text, plain = x, True
        else:
            text, plain = (x[1] if x[0] == "[" else x[0] * x[1]), bool(x[0] and x[1])
        if not plain:
            joined = False
        elif text:
            if joined:
                out[-1] += text
            else:
                out.append(text)
            joined = True
    return out


def _texts(blocks: list[_Block], references: set[str]) -> list[str]:
    """Inline text of all blocks below a list item; code in fences is no inline text."""
    out: list[str] = []
    for b in blocks:
        if b.kind in ("paragraph", "heading"):
            out += _inline("\n".join(b.lines), references)
        else:
            out += _texts(b.children, references)
    return out


def _segments(blocks: list[_Block], references: set[str]) -> list[str]:
    out: list[str] = []
    for b in blocks:
        if b.kind in ("paragraph", "heading"):
            out += [*_inline("\n".join(b.lines), references), "\n"]
        elif b.kind == "code":
            out += ["\n".join(b.lines) + "\n", "\n"]
        elif b.kind == "fence":
            out.append("".join(x + "\n" for x in b.lines))
        elif b.kind == "rule":
            out.append("")
        elif b.kind == "quote":
            out += [*_segments(b.children, references), "\n"]
        elif b.kind == "list":
            for item in b.children:
                out += [*_texts(item.children, references), "\n"]
    return out


def extract_markdown(data: bytes, name: str = "") -> Result:
    source = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
    references: set[str] = set()
    blocks = _parse(source.split("\n"), references)
    text = textnorm.py_strip_invisible("\r\n".join(_segments(blocks, references)), markdown=True)
    text = textnorm.py_collapse_ws(re.sub(r"\n+", "\n", text), markdown=True)
    return Result(textnorm.py_trim_space(text), "markdown")
