"""A tokenizer of HTML that is linear in the page, whatever the page holds."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A tag up to the ``>`` that is in no quoted value; values are quoted after an equals sign only.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)([^>]*+)>")
#: A tag as HTML has it: up to the end of the page if nothing ends it before.
_TO_END = re.compile(r"""<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)""")
#: What ends a comment after ``<!--``; the first two right behind it only.
_COMMENT = re.compile(r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))")
TEXT, START, END, OTHER = "text", "start", "end", "other"


def tokens(source: str, raw: frozenset[str] | set[str], lenient: bool = True) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page, in order.

    Elements named in ``raw``, which may change on the way, hold no markup: what is between them is left out. Comments (which end as HTML
    says, also at ``--!>``), declarations, instructions and end tags without a name are of kind other. A ``<`` that opens no tag is text. A raw element or a comment without an end goes on to the end of the page.

    A tag that runs to the end of the page, be it within quotes, ends the page, as HTML says. If ``lenient``, such a tag is text after
    the last ``>``, and before it, from the first tag on that runs to the end within quotes, tags end at the first ``>``. So nothing is scanned again and again.
    """
    at, n = 0, len(source)
    last, tag = (source.rfind(">"), _TAG) if lenient else (n, _TO_END)
    while at < n:
        i = source.find("<", at)
        if i < 0 or i > last and not source.startswith("<!--", i):
            yield TEXT, source[at:], ""
            return
        if i > at:
            yield TEXT, source[at:i], ""
        if source.startswith("<!--", i):
            yield OTHER, "", ""
            at = _COMMENT.match(source, i).end()
            continue
        if source.startswith(("<!", "<?"), i) or source.startswith("</", i) and i + 2 < n and not (source[i + 2].isascii() and source[i + 2].isalpha()):
            yield OTHER, "", ""
            at = source.find(">", i) + 1 or n
            continue
        m = tag.match(source, i)
        if not m and tag is _TAG and source[i + 1 : i + 3].lstrip("/")[:1].isalpha():
            tag = _LOOSE
            m = tag.match(source, i)
        if not m:
            yield TEXT, "<", ""
            at = i + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield END, name, ""
            continue
        yield START, name, m[3]
        if name in raw and not m[3].endswith("/"):
            end = _end_of(name).search(source, at, last + 1) if at <= last else None
            at = end.end() if end else n
            yield END, name, ""


_ends: dict[str, re.Pattern] = {}


def _end_of(name: str) -> re.Pattern:
    if name not in _ends:
        _ends[name] = re.compile(rf"</{re.escape(name)}(?![a-zA-Z0-9])[^>]*+>", re.I)
    return _ends[name]
