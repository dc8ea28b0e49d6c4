"""Extractors that are expressions only: no Python runs for these types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import textnorm


_WS = r"[ \t\n\f\r]"
#: The rest of a tag: up to the ``>`` that is in no quoted value, or to the end of the page.
_REST = rf"""(?:[^>=]++|={_WS}*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))|=)*+(?:>|\z)"""
_NAME_ENDS = r"(?=[ \t\n\f\r/>])"
_TAG = rf"[a-z][^ \t\n\f\r/>]*+{_REST}"
_COMMENT = r"<!--(?:-?>|(?s:.*?)(?:--!?>|\z))"
#: Declarations, instructions and end tags without a name; they end at the first ``>``.
_OTHER = r"<[!?][^>]*+(?:>|\z)|</(?![a-zA-Z]|\z)[^>]*+(?:>|\z)"


def _raw(names: str, group: int) -> str:
    """Elements that hold no markup, with all that is in them; without an end tag they go on to the end of the page."""
    return rf"<({names}){_NAME_ENDS}{_REST}(?<!/>)(?s:.*?)(?:</\{group}(?![a-zA-Z0-9])[^>]*+>|\z)"


_SCRIPT = "script|style"
_TEXTLESS = "title|template|noframes"


def _before_body(raw: str, group: int) -> str:
    """All that may stand before the body; a ``noscript`` only as long as the head has not been closed."""
    plain = rf"<(?:html|head|base|link|meta|basefont|bgsound|{raw}){_NAME_ENDS}{_REST}"
    return rf"(?:{_WS}|{_COMMENT}|{_OTHER}|{_raw(raw, group)}|</(?!head{_NAME_ENDS}){_TAG}|{plain})*+"


_HEAD = rf"(?i)\A{_before_body(f'{_SCRIPT}|{_TEXTLESS}|noscript', 1)}(?:</head{_REST}{_before_body(f'{_SCRIPT}|{_TEXTLESS}', 2)})*+"
_MARKUP = rf"(?i)(?=<)(?:{_COMMENT}|{_OTHER}|{_raw(_SCRIPT, 1)}|</?{_TAG})"


def html_text(source: Column, bare_references: bool = True) -> Column:
    """Text of a page's body outside scripts and styles; markup is space, references are decoded twice (without a semicolon too, if ``bare_references``).

    Right in general, as :mod:`textloom.operators.html` is: values in quotes may hold ``>``, comments end as HTML says, the head ends at
    the first thing that belongs to no head, raw elements end at their own end tag, a tag that the page ends in is no text.
    Each expression passes over the page once; possessive repetition keeps hostile pages linear and off the stack.
    """
    source = F.replace(source, F.lit("\0"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(source, _HEAD, ""), _MARKUP, "\0")
    text = textnorm.unescape(text, bare_references)
    # ends of segments are trimmed of more kinds of white space than are collapsed
    white = textnorm.WHITE_SPACE.removesuffix("+")
    both = white.replace("[", r"[\x00", 1)
    # white space is looked at from its first sign only, so a long run is passed once
    text = textnorm.unescape(F.regexp_replace(text, rf"(?:\x00|{white}(?<!{white}{{2}}){white}*+\x00){both}*+", " "), bare_references)
    return textnorm.trim_space(textnorm.collapse_ws(textnorm.strip_invisible(text)))


def plain_text(content: Column) -> Column:
    """Bytes as they are; bytes that are no UTF-8 become replacement marks."""
    return F.make_valid_utf8(content.cast("string"))


def vsd_text(content: Column) -> Column:
    """Printable ASCII and line ends of the whole content."""
    return textnorm.printable_ascii(F.decode(content, "ISO-8859-1"))


def pdf_scrape(content: Column) -> Column:
    """What stands in parentheses on one line of a PDF, space-separated: the last resort where nothing can be parsed."""
    text = F.decode(content, "ISO-8859-1")
    found = F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^)\n\r]+)\)"), F.lit(1)), " ")
    return F.when(F.startswith(text, F.lit("%PDF")), textnorm.trim_space(F.regexp_replace(found, r"[\t\n\f\r ]+", " ")))
