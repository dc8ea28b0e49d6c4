"""DOCX, XLSX, PPTX, ODT and VSDX: XML parts within ZIP containers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from textloom.functions.paths import py_part_number

from .result import ExtractError, Result
from .xml import events
from .zipped import Container

#: Headings, placeholders without content, and image suffixes.
HEADING = "【标题{}】 "
PLACEHOLDERS = frozenset(("sldNum", "date", "footer", "header", "dt", "ftr", "hdr"))
IMAGES = tuple(".png .jpg .jpeg .tif .tiff .webp .wbmp .fpx .pbm .pgm .gif .bmp .svg".split())
SHEET_HEADER = "=== 工作表: {} ===\n"


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ExtractError("entity declarations are not accepted")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ExtractError(f"XML: {e}") from e


def _local(x: ElementTree.Element) -> str:
    return x.tag.rpartition("}")[2]


def _below(x: ElementTree.Element, *path: str) -> Iterator[ElementTree.Element]:
    """Descendants by a path of direct children, names without namespaces."""
    if not path:
        yield x
        return
    for child in x:
        if _local(child) == path[0]:
            yield from _below(child, *path[1:])


def _numbered(names: list[str], folder: str, stem: str) -> list[str]:
    found = [n for n in names if re.fullmatch(rf"{folder}/{stem}\d+\.xml", n)]
    return sorted(found, key=lambda n: py_part_number(n, stem))


def extract_docx(data: bytes, name: str = "") -> Result:
    root = _tree(Container(data).read("word/document.xml"))
    paragraphs = []
    for p in _below(root, "body", "p"):
        style = next((v for s in _below(p, "pPr", "pStyle") for k, v in s.attrib.items() if k.rpartition("}")[2] == "val"), "")
        text = "".join(t.text or "" for t in _below(p, "r", "t"))
        level = re.fullmatch(r"[Hh]eading ?(\d+)", style)
        paragraphs.append((style, (HEADING.format(level[1]) if level else "") + text))
    return Result("".join(t + "\n" for _, t in paragraphs), "docx", paragraphs)


def sheets(data: bytes) -> Iterator[tuple[str, list[tuple[int, list[tuple[str, str]]]]]]:
    """For each sheet its rows with the reference and value of each cell that is not empty."""
    box = Container(data)
    shared: list[str] = []
    names = box.names()
    if "xl/sharedStrings.xml" in names:
        try:
            for si in _below(_tree(box.read("xl/sharedStrings.xml")), "si"):
                shared.append("".join(t.text or "" for t in [*_below(si, "t"), *_below(si, "r", "t")]))
        except ExtractError:
            shared = []
    for part in _numbered(names, "xl/worksheets", "sheet"):
        try:
            root = _tree(box.read(part))
        except ExtractError:
            continue
        rows = []
        for number, row in enumerate(_below(root, "sheetData", "row"), 1):
            cells = []
            for c in _below(row, "c"):
                value = next((v.text or "" for v in _below(c, "v")), "")
                if c.get("t") == "s" and value.isdecimal() and int(value) < len(shared):
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in [*_below(c, "is", "t"), *_below(c, "is", "r", "t")])
                if value:
                    cells.append((c.get("r", ""), value))
            if cells:
                rows.append((int(row.get("r") or number), cells))
        yield part.rpartition("/")[2], rows


def extract_xlsx(data: bytes, name: str = "") -> Result:
    parts = []
    for sheet, rows in sheets(data):
        parts.append((sheet, "".join("\t".join(v for _, v in cells) + "\n" for _, cells in rows)))
    return Result("".join(SHEET_HEADER.format(s) + t + "\n\f\n" for s, t in parts), "xlsx", parts)


def extract_pptx(data: bytes, name: str = "", as_written: bool = False) -> Result:
    """``as_written`` keeps paragraphs without text."""
    box, parts = Container(data), []
    for part in _numbered(box.names(), "ppt/slides", "slide"):
        try:
            root = _tree(box.read(part))
        except ExtractError:
            continue
        lines = []
        for shape in _below(root, "cSld", "spTree", "sp"):
            if any(ph.get("type") in PLACEHOLDERS for ph in [*_below(shape, "nvSpPr", "nvPr", "ph"), *_below(shape, "ph")]):
                continue
            for p in _below(shape, "txBody", "p"):
                text = "".join(t.text or "" for t in _below(p, "r", "t"))
                if text or as_written:
                    lines.append(text + "\n")
        parts.append((part.rpartition("/")[2], "".join(lines)))
    return Result("".join(t + "\f" for _, t in parts), "pptx", parts)


def extract_odt(data: bytes, name: str = "") -> Result:
    out: list[str] = []
    depth = 0

    def start(tag, attributes):
        nonlocal depth
        if tag in ("text:p", "text:h", "text:span"):
            depth += 1
        elif depth and tag == "text:s":
            count = attributes.get("text:c", "1")
            out.append(" " * min(int(count) if count.isdecimal() else 1, 1000))
        elif depth and tag == "text:tab":
            out.append("\t")
        elif depth and tag == "text:line-break":
            out.append("\n")

    def end(tag):
        nonlocal depth
        if tag in ("text:p", "text:h", "text:span"):
            depth -= 1
        if tag in ("text:p", "text:h"):
            out.append("\n")

    def text(x):
        if depth:
            out.append(x)

    events(Container(data).read("content.xml"), start, end, text)
    return Result("".join(out), "odt")


def media(data: bytes) -> list[tuple[str, bytes]]:
    """Images of a drawing."""
    box = Container(data)
    return [(n.rpartition("/")[2], box.read(n)) for n in box.names() if n.startswith("visio/media/") and n.lower().endswith(IMAGES)]


def image_names(data: bytes) -> list[str]:
    return [n for n in Container(data).names() if n.startswith("visio/media/") and n.lower().endswith(IMAGES)]


def extract_vsdx(data: bytes, name: str = "") -> Result:
    box, parts = Container(data), []
    for part in box.names():
        if not re.fullmatch(r"visio/pages/[^/]*\.xml", part):
            continue
        found: list[str] = []
        open_ = [0]

        def start(tag, attributes, open_=open_):
            if open_[0] or tag.rpartition(":")[2].endswith("Text"):
                open_[0] += 1

        def end(tag, open_=open_):
            if open_[0]:
                open_[0] -= 1

        try:
            events(box.read(part), start, end, lambda x, found=found, open_=open_: found.append(x) if open_[0] else None)
        except ExtractError:
            continue
        parts.append((part.rpartition("/")[2], "".join(found)))
    return Result("".join(t + "\n" for _, t in parts), "vsdx", parts)
