import random
import struct

import pytest

from pyspark.sql import functions as F
from textloom.operators.cfb import CompoundFile
from textloom.operators.legacy import extract_ppt
from textloom.plans import packers
from textloom.plans.records import BEYOND, BLOCK, CUT_OFF, biff, biff12, office_art, presentation_text, records, text_atoms


def walked(data, layout):
    """(position, kind, depth, offset, length, error) by a loop."""
    at, ends, out, error = 0, [], [], None
    while at < len(data):
        ends = [e for e in ends if e > at]
        room = ends[-1] if ends else len(data)
        opens = False
        try:
            if layout is office_art:
                v, kind, size = struct.unpack_from("<HHI", data, at)
                opens, head = v & 15 == 15, 8
            elif layout is biff:
                (kind, size), head = struct.unpack_from("<HH", data, at), 4
            else:
                head, kind, size = 1, data[at] & 127, 0
                if data[at] & 128:
                    kind, head = kind | (data[at + 1] & 127) << 7, 2
                for k in range(4):
                    byte = data[at + head]
                    size, head = size | (byte & 127) << 7 * k, head + 1
                    if byte < 128:
                        break
        except (struct.error, IndexError):
            error = error or CUT_OFF
            break
        offset, end = at + head, at + head + size
        if end > room:
            error = error or BEYOND
        if (offset if opens else end) > room:
            break
        out.append((len(out), kind, len(ends), offset, min(end, room) - offset if opens else size, None))
        at = offset if opens else end
        if opens:
            ends.append(min(end, room))
    return out + ([(None, None, None, None, None, error)] if error else [])


def record(kind, data, version=0):
    return struct.pack("<HHI", version, kind, len(data)) + data


def tree(rng, depth=0):
    out = b""
    for _ in range(rng.randrange(6)):
        out += record(rng.randrange(5000), tree(rng, depth + 1), 15 | rng.randrange(9) << 4) if depth < 4 and rng.random() < 0.4 else record(rng.randrange(5000), rng.randbytes(rng.randrange(40)), rng.randrange(15))
    return out


def varied(n, most):
    out = bytearray()
    for k in range(most):
        more = n >> 7 and k < most - 1
        out.append(n & 127 | (128 if more else 0))
        n >>= 7
        if not more:
            break
    return bytes(out)


def streams(layout):
    rng, out = random.Random(5), [None, b"", b"\1", b"\xff" * 3, b"\xff" * 40, bytes(60)]
    for _ in range(60):
        if layout is office_art:
            data = tree(rng)
        elif layout is biff:
            data = b"".join(struct.pack("<HH", rng.randrange(65536), n) + bytes(n) for n in rng.sample(range(300), rng.randrange(9)))
        else:
            data = b"".join(varied(rng.randrange(16384), 2) + varied(n, 4) + bytes(n) for n in rng.choices([0, 1, 127, 128, 300, 16384, 20000], k=rng.randrange(9)))
        out.append(data if rng.random() < 0.5 else data[: rng.randrange(len(data) + 1)])
        if data and rng.random() < 0.3:
            broken = bytearray(data)
            broken[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
            out.append(bytes(broken))
    return out


@pytest.mark.parametrize("layout", [office_art, biff, biff12])
def test_records_equal_a_loop(spark, layout):
    data = streams(layout)
    if layout is office_art:
        data += [record(1, b"", 15) * 3 + record(7, b"x"), record(3, b"") * (3 * BLOCK + 1), record(1, record(2, record(3, b"abc"), 15), 15)[:-1]]
    elif layout is biff:
        data.append(CompoundFile(packers.xls("s", [["a", 1, "b" * 9000]])).stream("Workbook"))
    rows = [(i, d, "clash") for i, d in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, bytes binary, kind string").repartition(3)
    got: dict = {}
    for r in records(df, "id", "bytes", layout).collect():
        got.setdefault(r.id, []).append((r.position, r.kind, r.depth, r.offset, r.length, r.error))
    for i, d in enumerate(data):
        assert sorted(got.get(i, []), key=lambda r: (r[0] is None, r)) == walked(d or b"", layout), i
    assert records(df.limit(0), "id", "bytes", layout).collect() == []


def test_payload_and_kinds(spark):
    data = record(1, record(TEXT := 0x0FA0, "é😀\n".encode("utf-16-le")) + record(5, b"no") + record(0x0FA8, b"\xe9\0"), 15)
    df = spark.createDataFrame([(1, data), (1, data), (2, data[:-1])], "id long, content binary")
    got = sorted(((r.id, r.position, r.kind, r.text, r.error) for r in text_atoms(df, "id").collect()), key=str)
    first = [(1, 1, TEXT, "é😀\n", None), (1, 3, 0x0FA8, "é\0", None)]
    assert got == sorted([*first, *first, (2, 1, TEXT, "é😀\n", None), (2, None, None, None, BEYOND)], key=str)
    raw = records(df.where("id = 1").limit(1), "id", payload=True).orderBy("position").collect()
    assert [r.raw and bytes(r.raw) for r in raw] == [None, "é😀\n".encode("utf-16-le"), b"no", b"\xe9\0"]
    plan = text_atoms(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "")


def test_presentations_equal_the_extractor(spark):
    files = [packers.ppt(t) for t in ([], ["a"], ["  x\ry ", "é\x0bz", " ", "n" * 3000], [f"line {i} ü" for i in range(700)])]
    rows = [(i, bytes(CompoundFile(f).stream("PowerPoint Document"))) for i, f in enumerate(files)]
    got = dict(spark.createDataFrame([*rows, (9, None), (10, b"")], "id int, content binary").select("id", presentation_text(F.col("content"))).collect())
    assert got == {**{i: extract_ppt(f).text for i, f in enumerate(files)}, 9: None, 10: ""}
