"""Extractors by type code. The first registration of a code holds unless it is overridden."""

from __future__ import annotations

import logging
from collections.abc import Callable

from textloom.functions import filetypes

from .archive import KINDS, extract_archive
from .html import extract_html
from .legacy import extract_doc, extract_ppt, extract_xls
from .markdown import extract_markdown
from .ooxml import extract_docx, extract_odt, extract_pptx, extract_vsdx, extract_xlsx
from .pdf import extract_pdf
from .result import ExtractError, Limits, Result
from .rtf import extract_rtf
from .xlsb import extract_xlsb
from .xml import extract_xml

log = logging.getLogger("textloom")
Extractor = Callable[[bytes, str], Result]
_NOT_PRINTABLE = bytes(b for b in range(256) if not (32 <= b <= 126 or b in (10, 13)))


def extract_raw(data: bytes, name: str = "") -> Result:
    return Result(data.decode("utf-8", "replace"), "raw")


def extract_text(data: bytes, name: str = "") -> Result:
    return Result(data.decode("utf-8", "replace"), "text")


def extract_vsd(data: bytes, name: str = "") -> Result:
    return Result(data.translate(None, _NOT_PRINTABLE).decode("ascii"), "vsd")


_BY_NAME: dict[str, Extractor] = {
    "html": extract_html, "text": extract_text, "xml": extract_xml, "markdown": extract_markdown, "doc": extract_doc, "docx": extract_docx, "xls": extract_xls, "xlsx": extract_xlsx, "ppt": extract_ppt,
    "pptx": extract_pptx, "pdf": extract_pdf, "xlsb": extract_xlsb, "odt": extract_odt, "rtf": extract_rtf, "vsdx": extract_vsdx, "vsd": extract_vsd,
}


class Registry:
    """Extractors of a session; it is pickled into workers with what was registered on the driver.

    Pages have references without a semicolon decoded, as HTML says, if ``bare_references``. Texts of slides keep blank ones and white space
    at their ends if ``slides_as_written``.
    """

    def __init__(self, limits: Limits = Limits(), fail_fast: bool = False, bare_references: bool = True, slides_as_written: bool = False):
        self.limits, self.fail_fast, self.bare_references, self.slides_as_written, self.own = limits, fail_fast, bare_references, slides_as_written, {}

    def register(self, code: int, extractor: Extractor, override: bool = False) -> bool:
        """Whether the extractor holds now; a code that is taken is left alone unless overridden."""
        if not override and (code in self.own or code in filetypes.EXTRACTORS or code == filetypes.UNKNOWN):
            log.warning("type %s has an extractor already", code)
            return False
        self.own[code] = extractor
        return True

    def extract(self, code: int, data: bytes, name: str = "") -> Result:
        """The text of a document; codes without an extractor have raw text. Whatever goes wrong is an ExtractError."""
        try:
            return self._extract(code, data, name)
        except ExtractError:
            raise
        except Exception as e:  # damaged or hostile bytes fail in many ways
            raise ExtractError(f"{type(e).__name__}: {e}") from e

    def _extract(self, code: int, data: bytes, name: str) -> Result:
        if code in self.own:
            return self.own[code](data, name)
        kind = filetypes.EXTRACTORS.get(code, "raw")
        if kind in KINDS:
            return extract_archive(kind, data, name, self.extract, self.limits, self.fail_fast)
        if kind == "html":
            return extract_html(data, name, self.bare_references)
        if kind in ("ppt", "pptx"):
            return _BY_NAME[kind](data, name, as_written=self.slides_as_written)
        return _BY_NAME.get(kind, extract_raw)(data, name)

    def safely(self, code: int, data: bytes | None, name: str = "") -> Result:
        """As :meth:`extract`, but an error is part of the result: one bad document fails no job."""
        if data is None:
            return Result("", filetypes.EXTRACTORS.get(code, "raw"), error="no content")
        try:
            return self.extract(code, data, name)
        except ExtractError as e:
            return Result("", filetypes.EXTRACTORS.get(code, "raw"), error=str(e))
