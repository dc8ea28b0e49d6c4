import io
import lzma
import random
import struct
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import members as by_position
from textloom.operators.archive import fold, walk
from textloom.operators.registry import Registry
from textloom.operators.result import Limits
from textloom.plans import packers
from textloom.plans import queries as base
from textloom.plans.walk import fold_offsets
from textloom.plans.walk import walk as walk_rows
from textloom.sources import archives

rng = random.Random(11)
FILES = {f"d{i % 5}/{i}.txt": bytes(rng.choice(b"abcdef \n") for _ in range(rng.choice([0, 1, 511, 512, 513, 3000]))) for i in range(300)}


def tar_of(files, form=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_of(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def put(folder, **archives_):
    for name, data in archives_.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return str(folder)


def contents(df):
    rows = df.orderBy("archive", "position").collect()
    return {r.entry: bytes(r.content) for r in rows if r.entry is not None and r.error is None}, [r for r in rows if r.error]


@pytest.mark.parametrize("part", [512, 7000, 1 << 20])
def test_parts_hold_every_file_once(spark, tmp_path, part):
    path = put(tmp_path, a__zip=zip_of(FILES), b__tar=tar_of(FILES), c__txt=b"no archive", _x__zip=b"hidden")
    df = archives.members(spark, path, part_bytes=part)
    for name in ("a.zip", "b.tar"):
        rows = df.where(F.col("archive").endswith(name))
        assert rows.count() == len(FILES) and contents(rows) == (FILES, [])
    parts = df.rdd.getNumPartitions()
    assert parts == 2 if part == 1 << 20 else parts > 20
    names = archives.members(spark, path, part_bytes=part, content=False)
    assert names.where("content is not null").count() == 0 and names.count() == 2 * len(FILES)


def test_one_archive_of_all_documents_in_several_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for kind in ("zip", "tar"):
        df = base.QUERIES[f"{kind}_parts"](spark, sf_dir)
        assert df.rdd.getNumPartitions() > 1
        assert sorted(tuple(r) for r in df.select("doc_id", "text").collect()) == sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
        assert df.where("error is not null").count() == 0


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tars_within_tars_and_long_names(spark, tmp_path, form):
    """What looks like a header within a member is none, wherever ranges begin."""
    inner = tar_of({f"in{i}.txt": b"x" * 700 for i in range(40)})
    files = {"a.tar": inner, **{f"é{'n' * (80 if form == tarfile.USTAR_FORMAT else 180)}{i}.txt": b"y" * (i * 37 % 900) for i in range(60)}, "b.tar": inner, "c.txt": b"end"}
    raw = tar_of(files, form)
    path = put(tmp_path, t__tar=raw)
    with open(f"{path}/t.tar", "rb") as f:
        want = [x[0] for x in by_position.tar_chain(f, 0, len(raw))]
        for part in (512, 1024, 2048, 5120, 1 << 15):
            for guesses in ({}, {s: g for s in range(0, len(raw), part) if (g := by_position.tar_guess(f, s, min(len(raw), s + part)))}):
                parts = by_position.tar_parts(f, len(raw), guesses, part)
                assert [x[0] for a, b in parts for x in by_position.tar_chain(f, a, b)] == want
    df = archives.members(spark, path, part_bytes=2048)
    assert df.rdd.getNumPartitions() > 5 and contents(df) == (files, [])


def test_damage_is_told_and_what_comes_before_stays(spark, tmp_path):
    tar, z = bytearray(tar_of(FILES)), bytearray(zip_of(FILES))
    at = [m.offset for m in tarfile.open(fileobj=io.BytesIO(bytes(tar)))][150]
    tar[at + 150] ^= 1
    records = [i for i in range(len(z)) if z[i : i + 4] == b"PK\x01\x02"]
    record = records[150]
    z[record] = 0
    flip = bytearray(zip_of({"a.txt": b"a" * 100, "rate-limit.txt": bytes(range(256)) * 9, "z.txt": b"z"}))
    flip[flip.find(b"rate-limit.txt") + 40] ^= 255
    cut = tar_of({"a.txt": b"a" * 100, "b.txt": b"b" * 5000})[:3000]
    path = put(tmp_path, a__tar=bytes(tar), b__zip=bytes(z), c__zip=b"no zip at all", d__zip=bytes(flip), e__tar=cut, f__zip=zip_of({}), g__tar=tar_of({}), h__tar=b"", i__tar=b"\1" * 2000)
    for part in (4096, 1 << 20):
        df = archives.members(spark, path, part_bytes=part)
        by = lambda n: contents(df.where(F.col("archive").endswith(n)))  # noqa: B023, E731
        names = list(FILES)
        for name in ("a.tar", "b.zip"):
            got, bad = by(name)
            assert got == {n: FILES[n] for n in names[:150]} and len(bad) == 1 and bad[0].entry is None
        assert [r.error for r in by("c.zip")[1]] == ["zip: no directory"]
        assert set(by("d.zip")[0]) == {"a.txt", "z.txt"} and [r.entry for r in by("d.zip")[1]] == ["rate-limit.txt"]
        assert set(by("e.tar")[0]) == {"a.txt"} and [r.entry for r in by("e.tar")[1]] == ["b.txt"]
        assert by("f.zip") == by("g.tar") == by("h.tar") == ({}, [])
        assert len(by("i.tar")[1]) == 1
    with pytest.raises(Exception, match="nothing-here"):
        archives.members(spark, f"{path}/nothing-here.zip").count()


def test_kinds_of_zip(spark, tmp_path):
    many = {f"{i}": b"" for i in range(70_000)}
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z:
        with z.open("w.txt", "w", force_zip64=True) as f:
            f.write(b"wide" * 10)
    encrypted = bytearray(zip_of({"e.txt": b"secret"}))
    struct.pack_into("<H", encrypted, encrypted.find(b"PK\x01\x02") + 8, 1)
    path = put(tmp_path, a__zip=b"#!front\n" + zip_of({"a.txt": b"A" * 99}, zipfile.ZIP_STORED), b__jar=zip_of({"dir/": b"", "b.txt": b"B"}, zipfile.ZIP_BZIP2), c__war=wide.getvalue(), d__zip=zip_of(many), e__zip=bytes(encrypted), f__zip=zip_of({"l.txt": b"l"}, zipfile.ZIP_LZMA))
    with zipfile.ZipFile(f"{path}/a.zip", "a") as z:
        z.comment = b"PK\x05\x06 a comment"
    df = archives.members(spark, path, entry_bytes=98)
    got, bad = contents(df.where("not archive like '%d.zip'"))
    assert got == {"b.txt": b"B", "w.txt": b"wide" * 10}
    assert {r.entry: r.error for r in bad} == {"a.txt": "zip: more than 98 bytes", "e.txt": "zip: encrypted", "l.txt": "zip: method 14"}
    assert contents(archives.members(spark, f"{path}/a.zip"))[0] == {"a.txt": b"A" * 99}
    assert archives.members(spark, f"{path}/d.zip", part_bytes=1 << 20).count() == 70_000


def test_later_files_replace_earlier_ones(spark, tmp_path):
    path = put(tmp_path, a__tar=tar_of({"x/../a.txt": b"old", "b.txt": b"b", "./a.txt": b"new", "../c.txt": b"c"}))
    rows = archives.files(spark, path).collect()
    assert {r.path: bytes(r.content) for r in rows} == {"a.txt": b"new", "b.txt": b"b", "c.txt": b"c"} and len(rows) == 3


def nested():
    deep = packers.tar({"z/y.txt": "tief".encode(), "a.md": b"# h"})
    return {"b.txt": b"two", "a/x.zip": packers.zipped({"q.txt": b"q", "in/deep.tar": deep, "empty.tar": packers.tar({})}), "a.txt": b"\xff", "a/broken.zip": b"zip?", "z.tar.gz": packers.gz(packers.tar({"k.txt": "é".encode()})), "p/w.html": b"<p>w"}


def test_walk_equals_the_walk_in_memory(spark, tmp_path):
    path = put(tmp_path, o__zip=zip_of(nested()), p__tar=tar_of(nested()))
    own = Registry()
    for name, kind in (("o.zip", "zip"), ("p.tar", "tar")):
        with open(f"{path}/{name}", "rb") as f:
            want = list(walk(kind, f.read(), name, own.extract))
        rows = walk_rows(spark, f"{path}/{name}", part_bytes=512)
        got = {tuple(r.entry_path): (r.text, r.method, r.error is None) for r in rows.collect()}
        assert got == {e.path: (e.text, e.method, e.error is None) for e in want}
        pieces = fold_offsets(rows).orderBy("offset").collect()
        assert "".join(r.block for r in pieces) == fold(want)
        ends = [0]
        for r in pieces:
            assert r.offset == ends[-1] and r.length == len(r.block.encode())
            ends.append(r.offset + r.length)


def test_fold_of_many_archives_of_all_sizes(spark):
    rows = [(f"a{i}", [f"f{k % 3}/{k}.txt"], "t" * (k % 7)) for i in range(40) for k in range(i * 3)] + [("a1", None, "lost"), (None, ["x"], "n"), ("e", [""], "damage")]
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fold_offsets(spark.createDataFrame(rows, "archive string, entry_path array<string>, text string").repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = {}
        for a, levels, t in sorted((r for r in rows if r[1] and r[1][-1]), key=lambda r: (str(r[0]), [x.split("/") for x in r[1]])):
            want.setdefault(a, []).append(f"=== 文件名: /{levels[-1]} ===\n\n{t}\n\n")
        text = {}
        for r in sorted(got, key=lambda r: r.offset):
            assert len("".join(text.setdefault(r.archive, [])).encode()) == r.offset
            text[r.archive].append(r.block)
        assert text == want
    assert fold_offsets(spark.createDataFrame([], "archive string, entry_path array<string>, text string")).collect() == []


def test_written_archives_appear_when_all_are_done(spark, tmp_path):
    archives.register(spark)
    df = spark.createDataFrame([(k, bytearray(v), 1) for k, v in FILES.items()] + [("null.txt", None, 1)], "entry string, content binary, extra int").repartition(3)
    for kind, ask in (("zip", zipfile.is_zipfile), ("tar", tarfile.is_tarfile)):
        out = tmp_path / kind
        df.write.format("archive").option("kind", kind).option("fileEntries", 40).mode("append").save(str(out))
        files = list(out.iterdir())
        assert len(files) >= 8 and all(ask(f) for f in files)
        assert contents(archives.members(spark, str(out)))[0] == FILES | {"null.txt": b""}
        failing = df.select(F.when(F.col("entry").startswith("d3"), F.raise_error(F.lit("stop"))).otherwise(F.col("entry")).alias("entry"), "content")
        with pytest.raises(Exception, match="stop"):
            failing.write.format("archive").option("kind", kind).mode("append").save(str(out))
        assert sorted(out.iterdir()) == sorted(files)
        df.limit(5).write.format("archive").option("kind", kind).mode("overwrite").save(str(out))
        assert archives.members(spark, str(out)).count() == 5


def test_limits_hold_for_all_levels_together():
    extract = Registry().extract
    bombs = packers.zipped({f"{i:02}.zip": packers.zipped({"big.txt": b"0" * 1_000_000}) for i in range(20)})
    found = list(walk("zip", bombs, "b.zip", extract, Limits(expanded_bytes=1_100_000)))
    assert sum(len(e.text) for e in found) <= 1_100_000 and sum(e.error is not None for e in found) >= 18
    many = packers.zipped({f"{i:02}.zip": packers.zipped({f"{k}.txt": b"" for k in range(10)}) for i in range(5)})
    assert sum(e.error is None for e in walk("zip", many, "m.zip", extract, Limits(entries=20))) == 15


@pytest.mark.parametrize("name", ["rate-limit.txt", "rate-other.txt"])
def test_a_name_is_no_limit(name):
    data = bytearray(packers.zipped({"a.txt": b"a", name: bytes(range(256)) * 20, "z.txt": b"z"}))
    data[data.find(name.encode()) + len(name) + 30] ^= 255
    found = list(walk("zip", bytes(data), "x.zip", Registry().extract))
    assert [(e.path[0], e.error is None) for e in found] == [("a.txt", True), (name, False), ("z.txt", True)]


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_parts_do_not_grow_in_number_with_the_archives(spark, tmp_path, kind):
    archives.register(spark)
    folder = str(tmp_path / "a")
    spark.range(60, numPartitions=2).selectExpr("concat(id, '.txt') AS entry", "cast(repeat(sha2(cast(id AS string), 256), 200) AS binary) AS content").write.format("archive").option("kind", kind).mode("append").save(folder)
    total = sum(p.stat().st_size for p in (tmp_path / "a").iterdir())
    size = archives.even_part_bytes(spark, folder, least=1)
    assert size == total // (archives.TASKS * spark.sparkContext.defaultParallelism) > 1
    assert archives.even_part_bytes(spark, folder, least=1 << 30, most=1 << 30) == 1 << 30 and archives.even_part_bytes(spark, folder, least=1, most=200) == 200
    reader = archives.ArchiveReader({"path": folder, "partBytes": str(size), "tarGuesses": '{"x": {"0": [0, 512]}}'})
    assert 1 < len(reader.partitions()) <= 2 * archives.TASKS * spark.sparkContext.defaultParallelism and not reader.guesses
    assert archives.members(spark, folder, part_bytes=size).where("error is null").count() == 60


def test_xz_of_short_texts_sets_up_no_long_dictionary():
    for n in (0, 1, 4096, 5000, 300_000):
        assert lzma.decompress(packers.XZ(b"ab" * n)) == b"ab" * n
    start = time.process_time()
    for _ in range(300):
        packers.XZ(b"short")
    mine, start = time.process_time() - start, time.process_time()
    for _ in range(300):
        lzma.compress(b"short")
    assert mine < time.process_time() - start
