import random
import struct

from textloom.operators.cfb import CompoundFile
from textloom.plans import packers
from textloom.plans import sectors as module
from textloom.plans.sectors import CIRCLE, LOST, SHARED, chains, fat_links, sectors


def rows_of(df):
    return {(r.file, r.first, r.position, r.sector, r.error) for r in df.collect()}


def test_chains_equal_a_walk(spark):
    rng, links, want = random.Random(3), [], set()
    for f in range(30):
        places = rng.sample(range(1000), rng.choice([0, 1, 2, 3, 90, 300]))
        at = 0
        while at < len(places):
            chain = places[at : at + rng.choice([1, 2, 7, 64, 65, 500])]
            at += len(chain)
            circle = rng.random() < 0.1
            links += [(f"f{f}", a, b) for a, b in zip(chain, [*chain[1:], chain[0] if circle else None], strict=True)]
            want |= {(f"f{f}", None, None, None, CIRCLE)} if circle else {(f"f{f}", chain[0], i, s, None) for i, s in enumerate(chain)}
    links += [links[0], (None, 1, 2), ("f0", None, 1)]
    df = spark.createDataFrame(links, "file string, sector long, next long").repartition(3)
    assert rows_of(chains(df)) == want
    assert chains(df.limit(0)).collect() == []


def test_faults(spark):
    links = [("a", 0, 1), ("a", 1, 9), ("b", 0, 2), ("b", 1, 2), ("b", 2, None), ("c", 5, 5), ("c", 1, None)]
    got = rows_of(chains(spark.createDataFrame(links, "file string, sector long, next long")))
    assert got == {("a", 0, 0, 0, None), ("a", 0, 1, 1, None), ("a", None, None, None, LOST), ("b", 0, 0, 0, None), ("b", 0, 1, 2, None), ("b", 1, 0, 1, None), ("b", None, None, None, SHARED), ("c", 1, 0, 1, None), ("c", None, None, None, CIRCLE)}


def test_chains_of_compound_files(spark):
    files = {f"{k}.doc": packers.doc("text é " * n) for k, n in enumerate((1, 700, 60_000))}
    df = spark.createDataFrame([*files.items(), ("x.doc", b"no compound file"), ("n.doc", None), ("s.doc", files["0.doc"][:600])], "path string, content binary").repartition(2)
    got = sectors(df).where("error is null and file <> 's.doc'").orderBy("file", "first", "position").collect()
    parts = {}
    for r in got:
        parts.setdefault((r.file, r.first), []).append(r.sector)
    for name, data in files.items():
        one = CompoundFile(data)
        assert {f for f, _ in parts} == set(files)
        for entry, kind, first, size in one.entries:
            if kind == 2 and size >= one.cutoff:
                raw = b"".join(data[(s + 1) * one.size : (s + 2) * one.size] for s in parts[name, first])
                assert raw[:size] == one.stream(entry)
    assert "Python" not in fat_links(df)._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def test_tables_beyond_the_header(spark):
    """A header that names no table itself: all stand in two further sectors that follow one another."""
    size, table = 512, []
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HHHH", head, 26, 3, 0xFFFE, 9, 6)
    struct.pack_into("<I", head, 48, 0xFFFFFFFE)
    struct.pack_into("<II", head, 68, 0, 2)
    struct.pack_into("<109I", head, 76, *[0xFFFFFFFF] * 109)
    first, second = [2] + [0xFFFFFFFF] * 126 + [1], [3] + [0xFFFFFFFF] * 126 + [0xFFFFFFFE]
    table = [0xFFFFFFFC] * 2 + [0xFFFFFFFD] * 2 + [5, 130, *[0xFFFFFFFF] * 122], [0xFFFFFFFF] * 2 + [0xFFFFFFFE] + [0xFFFFFFFF] * 125
    data = bytes(head) + b"".join(struct.pack("<128I", *x) for x in (first, second, *table)) + bytes(size * 130)
    got = rows_of(sectors(spark.createDataFrame([("a", data)], "path string, content binary")))
    assert got == {("a", 4, 0, 4, None), ("a", 4, 1, 5, None), ("a", 4, 2, 130, None)}


def test_files_that_are_done_are_written_no_more(spark, monkeypatch):
    rows, stored = [], module.shared.stored

    def counted(df, name):
        out = stored(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module.shared, "stored", counted)
    short = [(f, s, s + 1 if s < 2 else None) for f in range(500) for s in range(3)]
    links = [*short, *((-1, s, s + 1 if s < 255 else None) for s in range(256)), (-2, 7, 7), (-3, 1, None)]
    got = rows_of(chains(spark.createDataFrame(links, "file long, sector long, next long")))
    assert got == {*((f, 0, s, s, None) for f, s, _ in short), *((-1, 0, s, s, None) for s in range(256)), (-2, None, None, None, CIRCLE), (-3, 1, 0, 1, None)}
    assert sum(rows) < 4 * len(links) + 8 * 256
