"""Writers of small documents of every type, from paragraphs or cells: inputs for round trips. They share no code with the readers."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from xml.sax.saxutils import escape

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_T = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(paragraphs: list[str], heading: bool = False) -> bytes:
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f'<w:p>{style if heading and not i else ""}<w:r><w:t xml:space="preserve">{escape(p[:5])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(p[5:])}</w:t></w:r></w:p>' for i, p in enumerate(paragraphs))
    return zipped({"[Content_Types].xml": b"<Types/>", "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>{body}</w:body></w:document>'.encode()})


def xlsx(rows: list[list[str]]) -> bytes:
    """The first column as shared strings, the second inline, others as they are."""
    shared = list(dict.fromkeys(r[0] for r in rows if r))
    at = {s: i for i, s in enumerate(shared)}
    body = []
    for n, r in enumerate(rows, 1):
        cells = [f'<c r="A{n}" t="s"><v>{at[r[0]]}</v></c>', f'<c r="B{n}" t="inlineStr"><is><t>{escape(r[1])}</t></is></c>', *(f"<c><v>{escape(v)}</v></c>" for v in r[2:])]
        body.append(f'<row r="{n}">{"".join(cells)}</row>')
    items = "".join(f"<si><t>{escape(s[:3])}</t></si>" if len(s) <= 3 else f"<si><r><t>{escape(s[:3])}</t></r><r><t>{escape(s[3:])}</t></r></si>" for s in shared)
    return zipped({"xl/sharedStrings.xml": f"<sst {_S}>{items}</sst>".encode(), "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{''.join(body)}</sheetData></worksheet>".encode()})


def pptx(slides: list[list[str]]) -> bytes:
    files = {}
    for n, paragraphs in enumerate(slides, 1):
        number = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>7</a:t></a:r></a:p></p:txBody></p:sp>'
        # a bare carriage return would be read as the end of a line
        body = "".join(f"<a:p><a:r><a:t>{escape(x, {'\r': '&#13;'})}</a:t></a:r></a:p>" for x in paragraphs)
        files[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{number}<p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>".encode()
    return zipped(dict(sorted(files.items())))


def odt(paragraphs: list[str]) -> bytes:
    body = "".join(f"<text:p><text:span>{escape(p[:4])}</text:span>{escape(p[4:])}</text:p>" for p in paragraphs)
    return zipped({"content.xml": f"<office:document-content {_T}><office:body><office:text>{body}</office:text></office:body></office:document-content>".encode()})


def vsdx(pages: list[str], images: int = 0) -> bytes:
    files = {f"visio/pages/page{n}.xml": f"<PageContents><Shapes><Shape><Cell N='x'/><Text>{escape(p)}</Text></Shape></Shapes></PageContents>".encode() for n, p in enumerate(pages, 1)}
    return zipped(files | {f"visio/media/image{n}.png": b"\x89PNG" for n in range(images)} | {"visio/media/x.bin": b""})


def xml(paragraphs: list[str]) -> bytes:
    body = "".join(f"<p n='1'>{escape(p)}</p>" if i % 2 else f"<p><![CDATA[{p}]]></p>" for i, p in enumerate(paragraphs))
    return f'<?xml version="1.0" encoding="UTF-8"?><!-- note --><doc>{body}</doc>'.encode()


def rtf(paragraphs: list[str]) -> bytes:
    def sign(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if ord(c) < 128:
            return c
        units = struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}h", c.encode("utf-16-le"))
        return "".join(f"\\u{u}?" for u in units)

    body = "\\par\n".join("".join(map(sign, p)) for p in paragraphs)
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator x;}{\\info{\\author nobody}}\\pard\\f0 " + body + "}").encode("ascii")


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with sectors of 512 bytes; small streams lie in the mini stream."""
    mini, mini_fat, big = bytearray(), [], []
    places: dict[str, tuple[int, int]] = {}
    for name, data in streams.items():
        if len(data) >= 4096:
            big.append(name)
            continue
        n = max(1, -(-len(data) // 64))
        first = len(mini_fat)
        mini_fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        mini += data.ljust(64 * n, b"\0")
        places[name] = (first, len(data))
    sectors: list[bytes] = []
    fat: list[int] = []

    def add(data: bytes) -> int:
        n, first = max(1, -(-len(data) // 512)), len(sectors)
        padded = data.ljust(512 * n, b"\0")
        sectors.extend(padded[512 * i : 512 * i + 512] for i in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    for name in big:
        places[name] = (add(streams[name]), len(streams[name]))
    root = add(bytes(mini)) if mini else 0xFFFFFFFE
    mini_first = add(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else 0xFFFFFFFE

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size)

    directory = add(entry("Root Entry", 5, root, len(mini)) + b"".join(entry(n, 2, *places[n]) for n in streams))
    n_fat = 1
    while (len(sectors) + n_fat) > 128 * n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("the file is too large for this writer")
    first_fat = len(sectors)
    table = fat + [0xFFFFFFFD] * n_fat
    raw = struct.pack(f"<{len(table)}I", *table).ljust(512 * n_fat, b"\xff")
    sectors += [raw[512 * i : 512 * i + 512] for i in range(n_fat)]
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, mini_first, -(-len(mini_fat) // 128), 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *range(first_fat, first_fat + n_fat), *[0xFFFFFFFF] * (109 - n_fat)) + b"".join(sectors)


def doc(text: str) -> bytes:
    """A text of two pieces, the second 8-bit if it is ASCII."""
    half = len(text) // 2
    one, two = text[:half].encode("utf-16-le"), text[half:]
    narrow = two.isascii()
    raw = two.encode("ascii" if narrow else "utf-16-le")
    units = len(one) // 2, len(raw) // (1 if narrow else 2)
    base = 1024
    longs, pairs = [0] * 22, [0] * (2 * 0x5D)
    longs[3] = sum(units)
    begin = base + len(one)
    pieces = struct.pack("<3I", 0, units[0], sum(units)) + struct.pack("<HIH", 0, base, 0) + struct.pack("<HIH", 0, begin * 2 | 0x40000000 if narrow else begin, 0)
    table = b"\x01" + struct.pack("<H", 2) + b"\0\0" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    pairs[66:68] = [0, len(table)]
    fib = struct.pack("<HHHHHH", 0xA5EC, 0xC1, 0, 0, 0, 0x0200).ljust(32, b"\0") + struct.pack("<H", 14) + b"\0" * 28 + struct.pack("<H22I", 22, *longs) + struct.pack(f"<H{len(pairs)}I", 0x5D, *pairs)
    return compound({"WordDocument": fib.ljust(base, b"\0") + one + raw, "1Table": table})


def ppt(texts: list[str]) -> bytes:
    def record(kind: int, data: bytes, version: int = 0) -> bytes:
        return struct.pack("<HHI", version, kind, len(data)) + data

    atoms = b"".join(record(0x0FA8, t.encode("latin-1")) if t.isascii() else record(0x0FA0, t.encode("utf-16-le")) for t in texts)
    return compound({"PowerPoint Document": record(0x03E8, record(0x0FF0, atoms, 15) + record(0x0000, b"x"), 15), "Current User": b"u"})


def xls(name: str, rows: list[list[object]]) -> bytes:
    """Strings in a table of shared strings that is cut into CONTINUE records, numbers as they are."""
    strings: list[str] = []
    cells = b""

    def record(kind: int, data: bytes) -> bytes:
        return struct.pack("<HH", kind, len(data)) + data

    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if isinstance(v, str):
                strings.append(v)
                cells += record(0x00FD, struct.pack("<HHHI", r, c, 0, len(strings) - 1))
            elif isinstance(v, int):
                cells += record(0x027E, struct.pack("<HHHI", r, c, 0, (v << 2 | 2) & 0xFFFFFFFF))
            else:
                cells += record(0x0203, struct.pack("<HHHd", r, c, 0, v))
    parts, now = [], bytearray(struct.pack("<II", len(strings), len(strings)))
    for s in strings:
        wide = not s.isascii()
        if len(now) + 3 > 8000:
            parts.append(bytes(now))
            now = bytearray()
        now += struct.pack("<HB", len(s.encode("utf-16-le")) // 2, int(wide))
        raw, unit = (s.encode("utf-16-le"), 2) if wide else (s.encode("ascii"), 1)
        while raw:
            room = (8200 - len(now)) // unit * unit
            now += raw[:room]
            raw = raw[room:]
            if raw:
                parts.append(bytes(now))
                now = bytearray([int(wide)])
    parts.append(bytes(now))
    table = record(0x00FC, parts[0]) + b"".join(record(0x003C, p) for p in parts[1:])
    begin = record(0x0809, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0))
    end = record(0x000A, b"")
    raw_name = name.encode("utf-16-le")
    where = len(begin) + 4 + 8 + len(raw_name) + len(table) + len(end)
    bound = record(0x0085, struct.pack("<IHBB", where, 0, len(raw_name) // 2, 1) + raw_name)
    sheet = record(0x0809, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 0)) + cells + end
    return compound({"Workbook": (begin + bound + table + end + sheet).ljust(4096, b"\0")})


def xlsb(rows: list[list[object]]) -> bytes:
    def record(kind: int, data: bytes) -> bytes:
        size, head = len(data), bytearray([kind])
        while size >= 128:
            head.append(size & 127 | 128)
            size >>= 7
        return bytes(head) + bytes([size]) + data

    def text(s: str) -> bytes:
        return struct.pack("<I", len(s.encode("utf-16-le")) // 2) + s.encode("utf-16-le")

    shared, body = [], b""
    for r, row in enumerate(rows):
        body += record(0, struct.pack("<I", r) + b"\0" * 12)
        for c, v in enumerate(row):
            cell = struct.pack("<II", c, 0)
            if isinstance(v, str) and c == 0:
                shared.append(v)
                body += record(7, cell + struct.pack("<I", len(shared) - 1))
            elif isinstance(v, str):
                body += record(6, cell + text(v))
            elif isinstance(v, int):
                body += record(2, cell + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
            else:
                body += record(5, cell + struct.pack("<d", v))
    return zipped({"xl/sharedStrings.bin": b"".join(record(19, b"\0" + text(s)) for s in shared), "xl/worksheets/sheet1.bin": record(1, b"") + body, "xl/worksheets/binaryIndex1.bin": b"\xff\xff"})


def pdf(pages: list[list[str]], compress: bool = True) -> bytes:
    """Lines as 16-bit codes of a font with a map to Unicode."""
    signs = sorted({c for p in pages for line in p for c in line})
    written = {c: f"{i:04X}" for i, c in enumerate(signs, 1)}
    chars = [f"<{written[c]}> <{c.encode('utf-16-be').hex()}>" for c in signs]
    blocks = "".join(f"{len(chars[i : i + 100])} beginbfchar\n" + "\n".join(chars[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(chars), 100))
    cmap = f"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{blocks}".encode()
    objects: list[bytes] = []

    def stream(data: bytes) -> bytes:
        if compress:
            data = zlib.compress(data)
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data)

    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects += [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>".encode(), b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", stream(cmap)]
    for i, lines in enumerate(pages):
        body = "BT /F1 12 Tf 14 TL 72 700 Td\n" + "".join(f"<{''.join(map(written.__getitem__, line))}> Tj 0 -14 Td\n" for line in lines) + "ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode(), stream(body.encode())]
    out = b"%PDF-1.7\n"
    for n, o in enumerate(objects, 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def tar(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def gz(data: bytes, name: str = "") -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(name, "wb", fileobj=out, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def sevenzip(files: dict[str, bytes]) -> bytes:
    """One folder of LZMA2."""
    body = b"".join(files.values())
    packed = lzma.compress(body, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])

    def number(n: int) -> bytes:
        return bytes([n]) if n < 0x80 else b"\xff" + struct.pack("<Q", n)

    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n in files)
    sizes = [len(d) for d in files.values()]
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(packed)) + b"\0"
    streams += b"\x07\x0b" + number(1) + b"\0" + number(1) + b"\x21\x21\x01\x10" + b"\x0c" + number(len(body)) + b"\0"
    streams += b"\x08\x0d" + number(len(files)) + (b"\x09" + b"".join(map(number, sizes[:-1])) if len(files) > 1 else b"") + b"\0\0"
    header = b"\x01\x04" + streams + b"\x05" + number(len(files)) + b"\x11" + number(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(packed), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + packed + header


def rar(files: dict[str, bytes]) -> bytes:
    """Stored entries of version 4."""
    out = b"Rar!\x1a\x07\x00" + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6
    for name, data in files.items():
        raw = name.encode()
        out += struct.pack("<HBHHIIBIIBBHI", 0, 0x74, 0x8000, 32 + len(raw), len(data), len(data), 3, zlib.crc32(data), 0, 20, 0x30, len(raw), 32) + raw + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0x4000, 7)


BZ2 = bz2.compress


def XZ(data: bytes) -> bytes:
    """The usual preset with a dictionary no longer than the data: a longer one finds nothing more, and setting it up costs more than a short text."""
    size = max(4096, min(8 << 20, 1 << max(0, len(data) - 1).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])
