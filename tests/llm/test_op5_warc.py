import base64
import gzip
import hashlib
import random
import tracemalloc

import pytest

from textloom.llm import op5_warc as op


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows, least):
    first, out = {}, []
    for k, h in rows:
        b = (h or "").encode()
        if k is not None:
            first[b] = max(first.get(b, k), k)
    for k, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = len(b) >= least and f is not None and k != f
        out.append((k, len(b), digest(b), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


ROWS = [(1, "<p>a</p>"), (2, None), (3, ""), (4, "<p>a</p>"), (9, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (5, "é\U0001f600" * 1000), (6, "é\U0001f600" * 1000), (7, "long " * 50000), (8, "\r\n"), (8, "\r\n"), (None, "<p>a</p>"), (None, "only"), (10, "ends in CR\r")]


@pytest.mark.parametrize("least,chunk", [(0, 1 << 20), (0, 7), (9, 1000)])
def test_round_trip(spark, tmp_path, least, chunk):
    rows = ROWS if chunk > 100 else [(k, h[:300] if h else h) for k, h in ROWS]
    df = spark.createDataFrame([(k, "http://a/\r\nX: y", h, "z") for k, h in rows], "page_id long, url string, html string, digest string").repartition(2)
    op.write(df, f"{tmp_path}/w", least, chunk)
    table = op.read(spark, f"{tmp_path}/w").collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table if r.last], key=repr)
    assert got == brute(rows, least) and not any(r.error for r in table)
    parts = {}
    for r in table:
        parts.setdefault(r.record_id, []).append(r)
        assert r.chunk_bytes <= chunk
    assert len(parts) == len(rows) and len({(r.record_id, r.chunk) for r in table}) == len(table)
    payloads = []
    for rs in parts.values():
        rs.sort(key=lambda r: r.chunk)
        assert [r.chunk for r in rs] == list(range(1, len(rs) + 1)) and [r.last for r in rs] == [False] * (len(rs) - 1) + [True]
        if rs[0].record_type == "response":
            seen = b""
            for r in rs:
                seen += bytes(r.payload)
                assert r.payload_digest == digest(seen) and r.payload_bytes == len(seen)
            payloads.append((rs[0].page_id, seen))
    kept = {(k, d) for k, _, d, kind, _ in brute(rows, least) if kind == "response"}
    assert sorted(map(repr, payloads)) == sorted(repr((k, b)) for k, b in ((k, (h or "").encode()) for k, h in rows) if (k, digest(b)) in kept)


def test_archives_are_valid_warc(spark, tmp_path):
    df = spark.createDataFrame([(k, "http://a", h) for k, h in ROWS], "page_id long, url string, html string").coalesce(1)
    op.write(df, f"{tmp_path}/w", chunk_bytes=4096)
    data = gzip.decompress(next(tmp_path.glob("w/*.gz")).read_bytes())
    at = n = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        assert data[at:].startswith(b"WARC/1.1\r\n")
        head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(head[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n >= len(ROWS)


@pytest.mark.parametrize("window", [1, 5, 4096])
def test_small_windows_and_members(window):
    block = op._HTTP.encode() + b"pay\r\n\r\nload"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 7\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:WRONG\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    for data in (gzip.compress(record) * 3, gzip.compress(record * 3)):
        rows = list(op.parse(op.unzipped(iter([data[:9], b"", data[9:]]), window), window=window))
        assert [r["payload"] for r in rows] == [b"pay\r\n\r\nload"] * 3 and rows[0]["error"] == "payload digest differs"


def test_foreign_records_are_chunked(spark, tmp_path):
    """One record of another writer, without segments, whose payload is longer than a chunk."""
    payload = bytes(range(256)) * 40
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"x:1", b"x:2")))
    table = op.read(spark, str(tmp_path), chunk_bytes=1000).collect()
    for name in ("urn:x:1", "urn:x:2"):
        rows = sorted((r for r in table if r.record_id == name), key=lambda r: r.chunk)
        assert b"".join(bytes(r.payload) for r in rows) == payload and [r.chunk_bytes for r in rows] == [1000] * 10 + [240]
        assert rows[-1].payload_digest == digest(payload) and rows[-1].last and not any(r.error for r in rows)


def test_damaged_archives_are_error_rows(spark, tmp_path):
    import os

    df = spark.createDataFrame([(k, "http://a", os.urandom(3000).hex()) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    op.write(df, f"{tmp_path}/w")
    whole = next(tmp_path.glob("w/*.gz"))
    data = whole.read_bytes()
    (tmp_path / "w/cut.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "w/noise.gz").write_bytes(data[:20000] + b"\0" * 500 + data[20500:])
    (tmp_path / "w/other.gz").write_bytes(gzip.compress(b"no archive\r\n\r\n"))
    rows = op.read(spark, f"{tmp_path}/w").collect()
    good = [r for r in rows if r.error is None and r.last]
    assert sum(1 for r in rows if r.error) >= 3 and len({r.archive for r in rows}) == 4
    assert {r.page_id for r in good} == set(range(40)) and len(good) < 120
    assert all(r.payload_digest == digest(bytes(r.payload)) for r in good)


def member(k, size):
    payload = random.Random(k).randbytes(size // 2).hex().encode()
    return gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(payload), payload))


@pytest.mark.parametrize("size", [20, 20_000])
def test_damage_between_members_is_told(spark, tmp_path, size):
    """Six records in six members; whatever is wrong, what comes before is read and an error row tells the rest."""
    parts = [member(k, size) for k in range(6)]
    bad_head, flipped = bytearray(parts[2]), bytearray(parts[2])
    bad_head[:4], flipped[1] = b"\0\1\2\3", flipped[1] ^ 1
    files = {"head": [*parts[:2], bad_head, *parts[3:]], "flip": [*parts[:2], flipped, *parts[3:]], "trailer": [*parts[:5], parts[5][:-4]], "cut": [*parts[:2], parts[2][:12]], "none": [b"no gzip at all"], "whole": parts}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(data))
    (tmp_path / "plain.warc").write_bytes(b"".join(map(gzip.decompress, parts)))
    (tmp_path / "short.warc").write_bytes(gzip.decompress(parts[0])[:-30])
    names = {r.archive: r.name for r in spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("xxhash64(path) AS archive", "regexp_extract(path, '([a-z]+)[.]warc', 1) AS name").collect()}
    good, errors = {n: [] for n in names.values()}, {n: 0 for n in names.values()}
    for r in op.read(spark, str(tmp_path)).collect():
        if r.error:
            errors[names[r.archive]] += 1
        else:
            good[names[r.archive]].append(r.page_id)
    assert {n: sorted(x) for n, x in good.items()} == {"head": [0, 1], "flip": [0, 1], "trailer": [0, 1, 2, 3, 4, 5], "cut": [0, 1], "none": [], "whole": [*range(6)], "plain": [*range(6)], "short": []}
    assert errors == {n: int(n not in ("whole", "plain")) for n in names.values()}


def test_a_payload_of_one_long_line_is_not_held():
    size, peak = 64 << 20, 0
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % size
    packed = gzip.compress(head + b"x" * size + b"\r\n\r\n", 1)
    tracemalloc.start()
    rows = list(op.parse(op.unzipped(packed[i : i + 65536] for i in range(0, len(packed), 65536)), with_payload=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r["chunk_bytes"] for r in rows) == size and rows[-1]["last"] and peak < 20 << 20


def test_a_store_that_fails_is_no_damage(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc.gz").write_bytes(member(1, 20))
    df = op.read(spark, str(tmp_path))
    (tmp_path / "a.warc.gz").unlink()
    with pytest.raises(Exception):
        df.collect()


def test_stores_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "_known", lambda path: False)
    (tmp_path / "a.warc.gz").write_bytes(member(1, 20) + member(2, 20000)[:-9])
    rows = op.read(spark, str(tmp_path)).collect()
    assert [r.page_id for r in rows if not r.error] in ([1], [1, 2]) and sum(bool(r.error) for r in rows) == 1


def test_empty_table(spark, tmp_path):
    op.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert op.read(spark, f"{tmp_path}/w").count() == 0
