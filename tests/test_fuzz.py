"""Damaged documents: an extractor returns text or an error, and returns."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import filetypes, paths, textnorm
from textloom.operators.markdown import extract_markdown
from textloom.operators.registry import Registry
from textloom.operators.result import Limits, Result
from textloom.plans import packers

LINES = ["One line.", "zwei é", "3 (x) \\ {y}"]
GOOD = {
    1: b"<html><head><title>t</title></head><body><p a='b'>x<br>y &amp; z</p><script>1</script></body></html>", 3: packers.xml(LINES), 6: b"# h\n\n- a *b*\n  1. `c`\n\n> q\n\n```\nx\n```\n[l](u) ![i](v) <http://a>",
    7: packers.doc("\n".join(LINES)), 8: packers.docx(LINES), 9: packers.xls("S", [["a", 1, 0.5], ["é" * 3000, -1]]), 10: packers.xlsx([["a", "b", "1"]]), 11: packers.ppt(LINES), 12: packers.pptx([LINES]),
    13: packers.pdf([LINES], compress=False), 14: packers.xlsb([["a", 1, "b", 0.5]]), 15: packers.odt(LINES), 16: packers.rtf(LINES), 18: packers.tar({"a.txt": b"x"}), 19: packers.gz(b"x" * 99, "n.txt"),
    21: packers.zipped({"a.txt": b"x", "b.docx": packers.docx(LINES)}), 22: packers.sevenzip({"a.txt": b"x" * 50, "b.txt": b"y"}), 23: packers.rar({"a.txt": b"x"}), 24: packers.BZ2(b"x" * 99), 29: packers.XZ(b"x" * 99), 201: packers.vsdx(LINES), 202: b"v" * 50,
}
REGISTRY = Registry(Limits(expanded_bytes=8 << 20))


@pytest.mark.parametrize("code", list(GOOD))
def test_damaged_documents(code):
    rng = random.Random(code)
    for _ in range(150):
        data = bytearray(GOOD[code])
        for _ in range(rng.choice([1, 2, 8])):
            how, at = rng.randrange(4), rng.randrange(len(data))
            if how == 0:
                data[at] = rng.randrange(256)
            elif how == 1:
                del data[at : at + rng.randrange(1, 40)]
            elif how == 2:
                data[at:at] = data[at : at + rng.randrange(1, 40)]
            else:
                data[at : at + 4] = rng.choice([b"\xff\xff\xff\xff", b"\0\0\0\0", b"\xff\xff\xff\x7f", b"\1\0\0\0"])
            data = data or bytearray(b"\0")
        r = REGISTRY.safely(code, bytes(data), "f")
        assert isinstance(r, Result) and isinstance(r.text, str)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted({*filetypes.TYPES.values(), 114})), st.binary(max_size=400))
def test_any_bytes(code, data):
    assert isinstance(REGISTRY.safely(code, data, "x").text, str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_`[]()<>!#-+>1.\\\n\t~=", max_size=80))
def test_any_markdown(source):
    text = extract_markdown(source.encode()).text
    assert "\n\n" not in text and text == textnorm.py_trim_space(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab./\\", max_size=30))
def test_no_path_climbs_out(path):
    clean = paths.py_sanitize_path(path)
    assert not clean.startswith("/") and ".." not in clean.split("/") and paths.py_sanitize_path(clean) == clean
