from textloom.operators import ooxml
from textloom.plans import packers
from textloom.plans.workbooks import cells, sheet_lines, workbook_parts

SST = '<?xml version="1.0"?><x:sst xmlns:x="{s}"><x:si/><x:si><x:t xml:space="preserve"> a &amp; b </x:t></x:si><x:si><x:r><x:t>r1</x:t></x:r><x:rPh sb="0"><x:t>no</x:t></x:rPh><x:r><x:t>&#x72;2</x:t></x:r></x:si></x:sst>'
SHEET = """<worksheet xmlns="{s}"><sheetData><row/><row r='7' a="/"><c r="A7" t='s'><v>1</v></c><c r="B7"/><c r="C7" t="s"><v>2</v></c><c r="D7" t="s"><v>0</v></c><c r="E7" t="s"><v>99</v></c></row>
<row><c t="str"><f>x</f><v>1 &lt; 2</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c><v></v></c><c t="s"><v>-1</v></c></row></sheetData></worksheet>"""


def test_cells_by_hand(spark):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = packers.zipped({"xl/sharedStrings.xml": SST.format(s=s).encode(), "xl/worksheets/sheet2.xml": SHEET.format(s=s).encode(), "xl/worksheets/_rels/sheet2.xml.rels": b"<c/>", "xl/other.xml": b"<row><c><v>1</v></c></row>"})
    bare = packers.zipped({"xl/worksheets/sheet1.xml": b'<worksheet><sheetData><row><c t="s"><v>3</v></c></row></sheetData></worksheet>'})
    files = spark.createDataFrame([("a.xlsx", book, 1), ("b.xlsx", bare, 1), ("c.xlsx", b"no zip", 1), ("d.xlsx", None, 1), ("e.xlsx", packers.zipped({}), 1)], "path string, content binary, part int")
    parts = workbook_parts(files)
    assert [(r.path, r.error) for r in parts.where("error is not null").collect()] == [("c.xlsx", "zip: no directory")]
    got = sorted((r.path, r.sheet, r.row_no, r.cell_no, r.ref, r.value) for r in cells(parts).collect())
    assert got == [
        ("a.xlsx", "sheet2.xml", 3, 1, "", "1 < 2"), ("a.xlsx", "sheet2.xml", 3, 2, "", "inline"), ("a.xlsx", "sheet2.xml", 3, 4, "", "-1"),
        ("a.xlsx", "sheet2.xml", 7, 1, "A7", " a & b "), ("a.xlsx", "sheet2.xml", 7, 3, "C7", "r1r2"), ("a.xlsx", "sheet2.xml", 7, 5, "E7", "99"),
        ("b.xlsx", "sheet1.xml", 1, 1, "", "3"),
    ]
    assert {(r.path, r.row_no, r.line) for r in sheet_lines(cells(parts)).collect()} == {("a.xlsx", 3, "1 < 2\tinline\t-1"), ("a.xlsx", 7, " a & b \tr1r2\t99"), ("b.xlsx", 1, "3")}
    assert cells(workbook_parts(files.limit(0))).collect() == []


def test_equal_to_the_reader_in_memory(spark):
    books = {f"{n}.xlsx": packers.xlsx([[f"s{i % 3}<", f"é & {i}", str(i * n)] for i in range(n * 40)]) for n in range(4)}
    files = spark.createDataFrame(list(books.items()), "path string, content binary").repartition(3)
    want = {(p, sheet, row, ref, v) for p, data in books.items() for sheet, rows in ooxml.sheets(data) for row, cs in rows for ref, v in cs}
    found = cells(workbook_parts(files))
    assert {(r.path, r.sheet, r.row_no, r.ref, r.value) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
