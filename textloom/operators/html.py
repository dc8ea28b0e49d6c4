"""HTML by a tokenizer: text nodes outside head, script and style."""

from __future__ import annotations

from textloom.functions import textnorm

from .htmltokens import END, START, TEXT, tokens
from .result import Result

#: Elements that hold no markup, and those that hold none before the body begins.
RAW = frozenset(("script", "style"))
HEAD_RAW = frozenset(("title", "noscript", "template", "noframes"))
#: Other tags that may stand before the body.
HEAD_TAGS = frozenset(("html", "head", "base", "link", "meta", "basefont", "bgsound"))


def extract_html(data: bytes, name: str = "", bare_references: bool = True) -> Result:
    """Text segments outside head, script and style, in linear time.

    The head ends where HTML says, marked or not: at the first text that is no white space, or the first tag that belongs to no head. A tag
    that the page ends in, be it within a quoted value, is no text. References without a semicolon are decoded if ``bare_references``, as HTML says.
    """
    source = data.decode("utf-8", "replace").replace("\0", "")
    segments: list[str] = []
    held: list[str] = []
    raw = {*RAW, *HEAD_RAW}
    body = False

    def flush():
        if held:
            text = textnorm.py_trim_space(textnorm.py_unescape("".join(held), bare_references))
            if text:
                segments.append(text)
            held.clear()

    for kind, value, _ in tokens(source, raw, lenient=False):
        if kind == TEXT:
            body = body or bool(value.strip(" \t\n\f\r"))
            if body:
                raw -= HEAD_RAW
                held.append(value)
            continue
        flush()
        if kind == END and value == "head":
            raw.discard("noscript")
        if kind == START and not body and value not in raw and value not in HEAD_TAGS:
            body = True
            raw -= HEAD_RAW
    flush()
    text = textnorm.py_unescape(" ".join(segments), bare_references)
    return Result(textnorm.py_trim_space(textnorm.py_collapse_ws(textnorm.py_strip_invisible(text))), "html")
