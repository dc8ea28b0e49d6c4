import random

from pyspark.sql import functions as F
from textloom.functions import binary
from textloom.functions.charset import ENCODINGS, detect, py_decode, py_detect, with_text

SIMPLIFIED = "中国人民在这个城市里生活了很多年，他们知道什么时候下雨，也知道怎样把粮食收到家里。今天的天气不错。"
TRADITIONAL = "中國人民在這個城市裡生活了很多年，他們知道什麼時候下雨，也知道怎樣把糧食收到家裡。今天的天氣不錯。"


def cases():
    out = [(SIMPLIFIED.encode("gbk"), "gbk"), (TRADITIONAL.encode("big5"), "big5")]
    for text in ("plain ASCII", "déjà vu, über", SIMPLIFIED, TRADITIONAL, "Привет, мир", "a", "emoji 😀 here"):
        out += [(text.encode("utf-8"), "utf-8"), (text.encode("utf-16-le"), "utf-16le"), (text.encode("utf-16-be"), "utf-16be")]
        out += [(b"\xef\xbb\xbf" + text.encode(), "utf-8"), (text.encode("utf-16"), "utf-16le"), (b"\xfe\xff" + text.encode("utf-16-be"), "utf-16be")]
    return [*out, (b"", "utf-8"), (b"mixed " + SIMPLIFIED.encode("gbk") + b" text", "gbk"), (b"mixed " + TRADITIONAL.encode("big5") + b" text", "big5")]


def test_encodings_are_told_apart():
    for data, want in cases():
        assert py_detect(data)[0] == want, data
        assert 0 <= py_detect(data)[1] <= 1


def test_few_signs_that_are_valid_in_utf8_too(spark):
    """Pairs of gbk that UTF-8 reads as rare letters, or as Cyrillic within a Latin word; and short texts that are UTF-8."""
    signs = ["R一.", "D一.", "E小?.", "A山一水.", "E木小一小一."]
    latin = ["café", "kráľ", "như", "Ștefan", "Azərbaycan", "10 kΩ", "да", "(С) и", "жүрек һәм", "שלום", "مرحبا", "Հայ", "e\u0301"]
    data = [(t.encode("gbk"), "gbk") for t in signs] + [(t.encode(), "utf-8") for t in latin]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(data)], "id int, content binary")
    assert {r.id: (r.encoding, r.text) for r in with_text(df).collect()} == {i: (e, d.decode(e)) for i, (d, e) in enumerate(data)}
    assert [py_detect(d)[0] for d, _ in data] == [e for _, e in data]


def test_single_signs_that_utf8_reads_as_usual_letters(spark):
    signs = ["E木.", "A木木.", "?小.", "小", "1 小 小.", "木", "A.\nE木"]
    usual = ["soľ", "Oľga", "Iľja", "kľuka", "cieľ 5", "kráľ", "ľúto", "(С) и"]
    data = [(t.encode("gbk"), "gbk") for t in signs] + [(t.encode(), "utf-8") for t in usual]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(data)], "id int, content binary")
    assert {r.id: (r.encoding, r.text) for r in with_text(df).collect()} == {i: (e, d.decode(e)) for i, (d, e) in enumerate(data)}
    assert [py_detect(d)[0] for d, _ in data] == [e for _, e in data]


def test_expressions_equal_python(spark):
    rng = random.Random(7)
    data = [c for c, _ in cases()] + [b"\0", b"\xff", b"\x80" * 9, b"\xef\xbb", b"\xc3\xa9\xff"]
    for c, _ in cases():
        broken = bytearray(c)
        for _ in range(min(3, len(broken))):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        data += [bytes(broken), c[1:], c[:-1]]
    data += [rng.randbytes(rng.randrange(1, 200)) for _ in range(200)]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(data)] + [(-1, None, "y")], "id int, content binary, encoding string").repartition(3)
    got = {r.id: r for r in with_text(df).collect()}
    assert (got[-1].encoding, got[-1].confidence, got[-1].text) == (None, None, None)
    for i, d in enumerate(data):
        name, confidence = py_detect(d)
        assert got[i].encoding == name and abs(got[i].confidence - confidence) < 2e-6, d
        if i < len(cases()):
            assert got[i].text == py_decode(d, name), d
    assert {r.encoding for r in got.values()} == {*ENCODINGS, None}
    assert "Python" not in df.select(detect(F.col("content")))._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def mended(data: bytes, order: str) -> str:
    """UTF-16 by a loop over units."""
    units = [int.from_bytes(data[i : i + 2], order) if i + 2 <= len(data) else None for i in range(0, len(data), 2)]
    out, i = "", 0
    while i < len(units):
        u = units[i]
        if u is not None and 0xD800 <= u < 0xDC00 and i + 1 < len(units) and units[i + 1] is not None and 0xDC00 <= units[i + 1] < 0xE000:
            out, i = out + chr(0x10000 + (u - 0xD800 << 10) + units[i + 1] - 0xDC00), i + 2
        else:
            out, i = out + ("\ufffd" if u is None or 0xD800 <= u < 0xE000 else chr(u)), i + 1
    return out


def test_surrogates_alone_do_not_end_the_job(spark):
    rng = random.Random(11)
    units = [0x41, 0xE9, 0x4E2D, 0xD83D, 0xDE00, 0xD8D8, 0xDCDC, 0xA, 0xFFFD]
    data = [b"", b"\xd8"] + [b"".join(rng.choice(units).to_bytes(2, "little") for _ in range(rng.randrange(12))) + rng.choice([b"", b"", b"\xd8"]) for _ in range(200)] + ["é😀".encode("utf-16-le") * 50_000 + b"\0\xd8"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)] + [(-1, None)], "id int, c binary").repartition(2)
    got = {r.id: (r.little, r.big) for r in df.select("id", binary.utf16(F.col("c")).alias("little"), binary.utf16(F.col("c"), big=True).alias("big")).collect()}
    assert got == {-1: (None, None), **{i: (mended(d, "little"), mended(d, "big")) for i, d in enumerate(data)}}


def test_damage_everywhere_is_mended_in_one_pass(spark):
    """No unit of a text is an element of its own, however many are damaged."""
    data = [("é".encode("utf-16-le") + b"\x3d\xd8") * 200_000 + b"\xd8", "é😀".encode("utf-16-le") * 200_000]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, c binary").select("id", binary.utf16(F.col("c")).alias("t"))
    assert {r.id: r.t for r in df.collect()} == {0: "é�" * 200_000 + "�", 1: "é😀" * 200_000}
    assert "transform(" not in df._jdf.queryExecution().toString() and "regexp_extract_all" not in df._jdf.queryExecution().toString()
