"""XML character data, leniently; documents that declare entities are refused."""

from __future__ import annotations

import html
import re
from xml.parsers import expat

from textloom.functions import textnorm

from .result import ExtractError, Result

_LOOSE = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>|</?[A-Za-z_:][^>]*>", re.S)


def events(data: bytes, start=None, end=None, text=None) -> None:
    """Run expat over a document; text is called once for each run of character data."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = start or (lambda *a: None)
    parser.EndElementHandler = end or (lambda *a: None)
    parser.CharacterDataHandler = text
    parser.CommentHandler = parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = lambda *a: None
    parser.ProcessingInstructionHandler = lambda *a: None

    def refuse(*_):
        raise ExtractError("entity declarations are not accepted")

    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ExtractError(f"XML: {e}") from e


def _segments(data: bytes) -> tuple[list[str], str]:
    found: list[str] = []
    try:
        events(data, text=found.append)
        return found, "xml"
    except ExtractError as e:
        if "not accepted" in str(e):
            raise
    source, found, at = data.decode("utf-8", "replace"), [], 0
    for m in _LOOSE.finditer(source):
        found.append(html.unescape(source[at : m.start()]))
        if m[1] is not None:
            found.append(m[1])
        at = m.end()
    found.append(html.unescape(source[at:]))
    return found, "xml-lenient"


def extract_xml(data: bytes, name: str = "") -> Result:
    found, method = _segments(data)
    text = html.unescape(" ".join(s for s in map(textnorm.py_trim_space, found) if s))
    return Result(textnorm.py_trim_space(textnorm.py_collapse_ws(textnorm.py_strip_invisible(text))), method)
