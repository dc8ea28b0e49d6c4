import html
import random
import time
from collections import Counter
from html.entities import html5
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from textloom.functions import filetypes, paths, textnorm
from textloom.operators import native
from textloom.operators.html import extract_html
from textloom.operators.registry import Registry
from textloom.operators.rtf import DESTINATIONS
from textloom.plans.extract import extract_documents
from textloom.plans.queries import QUERIES

NAMES = [("A.TAR.GZ", 20), ("xtar.gz", 20), ("a.tar.bz2", 24), (".gz", 19), ("n.", 114), ("a.b/c", 114), ("none", 114), ("", 114), ("x.md", 6), ("x.tgz", 114), ("x.htm", 114), ("x.HTML", 1), ("k.key", 17), ("z.z", 30), ("i.svg", 36), ("b.bmp", 404), ("a/b.c/d.docx", 8), ("x.vsd", 202), ("x.yaml", 114)]


def test_types_of_names(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES] + [(f"q.{s}",) for s in filetypes.TYPES], "name string")
    rows = df.select("name", filetypes.detect_type(F.col("name")).alias("t"), filetypes.extension_of(F.col("name")).alias("e")).collect()
    assert [r.t for r in rows[: len(NAMES)]] == [t for _, t in NAMES]
    assert all(r.t == filetypes.detect(r.name) and r.e == filetypes.extension(r.name) for r in rows)


def test_classes_and_dimension(spark):
    rows = {r.ext: r for r in filetypes.file_types(spark).collect()}
    assert rows["md"].extractor == "markdown" and rows["jpg"].extractor == "raw" and rows["zip"]["class"] == "archive"
    df = spark.createDataFrame([(c,) for c in (1, 7, 21, 33, 114, 17)], "c int")
    assert [tuple(r) for r in df.select(filetypes.type_class(F.col("c")), filetypes.extractor_name(F.col("c"))).collect()] == [("text", "html"), ("document", "doc"), ("archive", "zip"), ("image", "raw"), ("other", "raw"), ("document", "raw")]


TEXTS = ["", " \x0b\x85a b　 c\x00​﻿ ", "\t\n\f\r", "x\r\ny\rz", "a\x1c b", "   ", "é‎\x7f"]


def test_expressions_equal_functions(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for expr, fn in (
        (textnorm.strip_invisible, textnorm.py_strip_invisible), (lambda c: textnorm.strip_invisible(c, True), lambda t: textnorm.py_strip_invisible(t, True)),
        (textnorm.collapse_ws, textnorm.py_collapse_ws), (lambda c: textnorm.collapse_ws(c, True), lambda t: textnorm.py_collapse_ws(t, True)),
        (textnorm.trim_space, textnorm.py_trim_space), (textnorm.clean_line, textnorm.py_clean_line),
    ):
        assert [r[0] for r in df.select(expr(F.col("t"))).collect()] == [fn(t) for t in TEXTS]


def test_unescape(spark):
    rng = random.Random(2)
    texts = [f"a&{n}b &{n[:-1]} &{n}" for n in html5]
    texts += [f"&#{n};&#x{n:x}; &#X{n:X} &#0{n}z" for n in (*range(400), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**25)]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&notit;", "&amp;lt;", "&a&b&", "&copycopy&nbsp", "&" + "n" * 40 + ";"]
    texts += ["".join(rng.choice(["&", "#", "x", "12", "amp", "lt", ";", " ", "not", "é", "\n", "<"]) for _ in range(rng.randrange(12))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", textnorm.unescape(F.col("t")).alias("u"))
    assert [(r.t, r.u) for r in df.collect()] == [(t, html.unescape(t)) for t in texts] + [(None, None)]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([("&amp;" * 200_000,)], "t string").select(F.length(textnorm.unescape(F.col("t"))))
    assert long.first()[0] == 200_000


PIECES = ["<a=", "</", "<p>", "</p>", "<head>", "</head>", "<title>", "</title>", "<script>", "</script>", "<style>", "</style >", "<!--", "-->", "--!>", "<!-->", "<!doctype html>", "<?x", "</ x>", "</>", '<a b="x>y">', "<a b='>'>", '<a b="', "'", '"', ">", "<", "x", "y &amp;amp; z", " ", "\n", "<meta a>", "<noscript>", "</noscript>", "<br/>", "<title/>", "\x85", " ", "\0", "<template>", "</template>", "= ", "<p = '", "&lt;", "1 < 2", "<html>", "<body>"]


def test_html_by_expressions_equals_the_tokenizer(spark):
    rng = random.Random(7)
    pages = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(16))) for _ in range(5000)]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "p string").select(native.html_text(F.col("p"))).collect()]
    assert got == [extract_html(p.encode()).text for p in pages]


def test_html_by_hand(spark):
    cases = {
        "<title>t</title><p>a": "a", "<head><title>t<p>a</title>b": "b", "<head>text<p>x": "text x", "<meta a><p title='a > b'>x</p>": "x",
        "<article><p>one</p><!--><p>two</p></article>": "one two", "<!-- x --!><p>two</p><!-- y -->": "two", "a<!--->b": "a b", "<!-- a": "",
        "<p>a</ b>c</>d": "a c d", "<body><title>in body</title>": "in body", "<head><noscript><p>no</p></noscript></head><noscript>yes</noscript>": "yes",
        "<script>'</script'</script>a<SCRIPT>b</Script >c": "a c", "<p>a<a href='": "a", "1 < 2 <3": "1 < 2 <3", "&amp;lt;b&amp;gt;": "<b>", "a<br>b": "a b", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert [r[0] for r in df.select(native.html_text(F.col("p"))).collect()] == list(cases.values())
    assert [extract_html(k.encode()).text for k in cases] == list(cases.values())


@pytest.mark.parametrize("page", ["<meta>" * 200_000, "<" * 200_000, '<a b="' * 100_000, "<!--" * 100_000 + ">", "<script>" * 100_000, "<a b='\">" * 100_000, "<a" * 200_000 + ">", " " * 400_000, "</" * 200_000 + ">", "<a b=\">\" " * 100_000 + ">", "<a b=\">\" " * 100_000, "<meta b='>' " * 100_000])
def test_hostile_pages_take_linear_time(spark, page):
    start = time.perf_counter()
    assert spark.createDataFrame([(page,)], "p string").select(native.html_text(F.col("p"))).first()[0] == extract_html(page.encode()).text
    assert time.perf_counter() - start < 20


def test_references_that_must_end_in_a_semicolon(spark):
    """What the SQL of the queries over pages states; a heading may be cut within a reference."""
    cases = {"<h1>a &amp;&amp</h1><p>b &copy; &lt": "a &&amp b © &lt", "&amp;amp;&ampx; &#65 &#65;&#x42;": "&&ampx; &#65 AB", "&notit; &eacute;&eacute &am": "&notit; é&eacute &am", "&amp;amp x": "&amp x"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert [r[0] for r in df.select(native.html_text(F.col("p"), bare_references=False)).collect()] == list(cases.values())
    assert [extract_html(k.encode(), bare_references=False).text for k in cases] == list(cases.values())
    files = df.select(F.lit("f.html").alias("path"), F.col("p").cast("binary").alias("content"))
    assert [r.text for r in extract_documents(files, registry=Registry(bare_references=False)).collect()] == list(cases.values())
    assert Registry(bare_references=False).extract(1, b"&lt").text == "&lt" and Registry().extract(1, b"&lt").text == "<"


@pytest.mark.parametrize("query", ["html_text", "html_text_udf", "html_text_size", "extracted_totals", "sink_metrics"])
def test_queries_leave_references_without_a_semicolon(spark, tmp_path, query):
    page, text = "<h1>a &amp;&amp</h1>b", "a &&amp b"
    spark.createDataFrame([(1, page)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "xyz")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect()]
    want = {"extracted_totals": (1, len(text)), "html_text_size": (1, len(text)), "sink_metrics": ("bytes", len(text) + 3)}
    assert want.get(query, (1, text)) in got


PATHS = ["../../x", "/a/../../b", "a//b/./c/", "", ".", "a\\..\\b", "..", "a/b/../../.."]


def test_sanitize_path(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = [r[0] for r in df.select(paths.sanitize_path(F.col("p"))).collect()]
    assert got == [paths.py_sanitize_path(p).replace(".", "") if p in ("", ".") else paths.py_sanitize_path(p) for p in PATHS]
    assert got[:2] == ["x", "b"]


@pytest.mark.parametrize("prefix,found", [("", True), ("f", True), ("fonttbl", True), ("fonttblx", False), ("zz", False), ("tab", True)])
def test_prefix_match(spark, prefix, found):
    assert spark.range(1).select(paths.prefix_match(DESTINATIONS, F.lit(prefix))).first()[0] is found


def test_part_number(spark):
    df = spark.createDataFrame([("a/sheet12.xml",), ("sheet.xml",), ("sheet99999999999.xml",)], "n string")
    assert [r[0] for r in df.select(paths.part_number(F.col("n"), "sheet")).collect()] == [12, 0, 0]
    assert paths.py_part_number("x/slide7.xml", "slide") == 7


def test_tables_of_references_are_dealt_evenly(spark):
    """A look-up meets a few entries of some thousand, and a usual reference, whatever its form, needs no pattern of names."""
    parts = Counter(crc32(k.encode()) % textnorm._PARTS for k in textnorm._USUAL)
    assert len(textnorm._USUAL) > 3000 and max(parts.values()) <= 6
    keys = ["amp", "#101", "#xA9", "#x4e00", "#19968", "#54999", "#xD7FF", "#xD800", "#55296", "nothing", "#0", "#128"]
    x = F.struct(F.concat("k", F.lit("; x;")).alias("piece"), F.col("k").alias("name"))
    got = {r.k: r.v for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", textnorm._usual(x).alias("v")).collect()}
    assert {k: v for k, v in got.items() if v is None}.keys() == {"#xD800", "#55296", "nothing"}
    assert all(v == html.unescape(f"&{k};") for k, v in got.items() if v is not None)


def test_long_white_space_is_passed_once(spark):
    page = "<p>a" + " " * 300_000 + "b<p>" + "\t" * 300_000 + "c"
    begun = time.time()
    assert spark.createDataFrame([(page,)], "p string").select(native.html_text(F.col("p"))).first()[0] == "a b c"
    assert time.time() - begun < 20
