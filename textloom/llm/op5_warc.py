"""WARC archives by way of a chunked record table.

Writing: each page is one logical record. Of records with equal payloads of at least ``least_bytes`` bytes the one
with the largest page_id is the response, the others revisit it. A payload longer than ``chunk_bytes`` is cut into slices, of
which a segment record and continuation records are made, one row each, so no block is larger than a chunk and no row
but the page's own holds a whole payload. Rows are written by Spark's text writer with the record terminator as line
separator: gzip archives in any store, one for each input partition, committed as Spark commits files.

Reading: Spark lists the archives (``.gz`` and ``.warc``), a task opens each by ``pyarrow.fs``, decompresses it window by window and parses it in
order: neither an archive nor a record nor a line of a payload is ever held. (Archives in a store that pyarrow does not know come as
rows of Spark's binary reader, one whole archive each.) A row is a record identifier, a chunk number and a chunk of at most ``chunk_bytes``, with the
digest of the payload up to and with it; the last chunk's digest is that of the whole payload. A digest that
differs from the declared one is reported in ``error``; an archive that is damaged anywhere, ends early or is none gives what could be read
and a row that has only ``archive`` (a hash of its path) and ``error``. An error of the store is no damage: it fails the task, which runs again. A file of no bytes has no records.

The group of equal payloads is only aggregated to its largest id. Responses of groups are broadcast up to
``BROADCAST_GROUPS`` rows; beyond it they are joined by digest, where adaptive execution splits a hot digest.

Defined cases: a null or empty payload is empty; a null page_id counts as the smallest and is null again when read, and
is the response of its group only if no record there has an id; among repeated rows with the largest id each
is a response; records of repeated ids have identifiers of their own, and no revisit names one of several; CR and LF in a URL are percent-encoded, a null URL is left out; an empty table writes archives
without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import archives

from .common import cut, frugal, new_path, table

CHUNK_BYTES = 1 << 20
BROADCAST_GROUPS = 200_000
WINDOW = 1 << 16
#: Bytes read at once, and of a header line beyond which an archive is damaged.
READ_BYTES, LONGEST_LINE = 1 << 18, 8 << 20
DATE = "2025-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, four signs, at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(name: Column) -> Column:
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))).otherwise("")


def records(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each WARC record to write: page_id, chunk and value, the record without its terminator."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload")))
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "n", "first")
    # ids that several rows have: these rows are told apart by their place in the table
    ids = pages.groupBy("page_id").agg(F.count("*").alias("k")).where("k > 1").select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("own"), F.lit(True).alias("shared"))
    ids = _sent(cut(ids))
    groups = groups.withColumn("own", F.col("first").cast("string")).join(ids, "own", "left").select("digest", "n", "first", F.col("shared").alias("first_shared"))
    groups = _sent(cut(groups))
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("own", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    rows = rows.join(groups, ["digest", "n"], "left").join(ids, "own", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.withColumn("refers_to", refers).withColumn("chunks", F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes))).cast("int"))
    name = F.concat(F.lit("page:"), F.col("own"), F.when(F.col("shared"), F.concat(F.lit(":"), F.col("place").cast("string"))).otherwise(""))
    origin = _urn(name)
    # slices first, so that the payload is not copied into each row
    piece = lambda i: F.struct(i.alias("chunk"), F.substring(F.col("payload"), (i - 1) * chunk_bytes + 1, F.lit(chunk_bytes)).alias("part"))
    pieces = F.when(F.col("refers_to").isNotNull(), F.array(F.struct(F.lit(1).alias("chunk"), F.lit(b"").alias("part")))).otherwise(F.transform(F.sequence(F.lit(1), F.col("chunks")), piece))
    rows = rows.select("page_id", "url", "n", "digest", "refers_to", "first_shared", "chunks", name.alias("name"), origin.alias("origin"), F.explode(pieces).alias("piece")).select("*", "piece.chunk", "piece.part").drop("piece")
    name, origin, revisit, more, part = F.col("name"), F.col("origin"), F.col("refers_to").isNotNull(), F.col("chunk") > 1, F.col("part")
    block = F.when(more, part).when(revisit, F.lit(_HTTP).cast("binary")).otherwise(F.concat(F.lit(_HTTP).cast("binary"), part))
    split = F.col("chunks") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(more, "continuation").when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.when(more, _urn(F.concat(name, F.lit("#"), F.col("chunk").cast("string")))).otherwise(origin),
        _field("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.when(more, "").otherwise("\r\nContent-Type: application/http; msgtype=response"),
        _field("X-Page-ID", F.col("page_id")),
        F.when(more, "").otherwise(F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"))),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}"), _field("WARC-Refers-To", F.when(F.col("first_shared").isNull(), _urn(F.concat(F.lit("page:"), F.col("refers_to").cast("string"))))), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(""),
        F.when(split, F.concat(F.lit("\r\nWARC-Segment-Number: "), F.col("chunk").cast("string"))).otherwise(""),
        F.when(more, F.concat(F.lit("\r\nWARC-Segment-Origin-ID: "), origin)).otherwise(""),
        F.when(more & (F.col("chunk") == F.col("chunks")), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), (F.col("n") + len(_HTTP)).cast("string"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select("page_id", "chunk", F.concat(head.cast("binary"), block).cast("string").alias("value"))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small


def write(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write gzip archives into a new folder."""
    records(pages, least_bytes, chunk_bytes).select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def unzipped(blocks: Iterator[bytes], window: int = WINDOW) -> Iterator[bytes]:
    """The bytes of an archive, gzip of any number of members or plain, window by window.

    Damage raises ``zlib.error``, ``EOFError`` or ``ValueError``.
    """
    first = next((b for b in blocks if b), b"")
    blocks = chain([first], blocks)
    if first.startswith(b"WARC/"):
        yield from blocks
        return
    if not first.startswith(b"\x1f\x8b"):
        raise ValueError("no gzip")
    unpack = None
    for data in blocks:
        more = bool(data)
        while more:
            unpack = unpack or zlib.decompressobj(31)
            out = unpack.decompress(data, window)
            if out:
                yield out
            if unpack.eof:
                data, unpack = unpack.unused_data, None
                more = bool(data)
            else:
                data = unpack.unconsumed_tail
                more = bool(data) or len(out) == window
    if unpack is not None:
        raise EOFError("cut off")


class _Stream:
    """Lines and exact lengths of bytes from an iterator of bytes."""

    def __init__(self, parts: Iterator[bytes], window: int = WINDOW):
        self.parts, self.window, self.buffer = parts, window, bytearray()

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.buffer += part
        return True

    def line(self) -> bytes | None:
        """Up to the next CRLF, without it; None at the end."""
        start = 0
        while (i := self.buffer.find(b"\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 1)
            if start > LONGEST_LINE:
                raise ValueError("a header line without an end")
            if not self._more():
                if self.buffer:
                    raise EOFError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in parts no longer than a window."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.buffer[: min(n, self.window)])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


_NOTHING = {"record_id": None, "chunk": None, "page_id": None, "record_type": None, "refers_to": None, "payload": None, "chunk_bytes": None, "last": None, "payload_bytes": None, "payload_digest": None, "archive": None, "error": None}


def parse(parts: Iterator[bytes], with_payload: bool = True, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Rows of the chunked record table of one archive, given its decompressed bytes; the last one tells of damage."""
    try:
        yield from _records(_Stream(iter(parts), window), with_payload, chunk_bytes)
    except (EOFError, ValueError, zlib.error) as e:
        yield _NOTHING | {"error": f"archive: {e}"}


def _records(stream: _Stream, with_payload: bool, chunk_bytes: int) -> Iterator[dict]:
    origin: dict = {}
    while (first := stream.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("a record starts without its version")
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        if line is None:
            raise EOFError("the archive ends inside a record")
        number, left = int(head.get("warc-segment-number", 1)), int(head["content-length"] if "content-length" in head else "no length")
        lost = None
        if number == 1 or not origin or head.get("warc-segment-origin-id") != origin["head"].get("warc-record-id"):
            lost = "continuation without its start" if number > 1 else None
            start = head if number == 1 else head | {"warc-record-id": head.get("warc-segment-origin-id", ""), "warc-payload-digest": ""}
            origin = {"head": start, "digest": hashlib.sha1(), "bytes": 0, "chunk": number - 1, "http": number == 1 and head.get("content-type", "").startswith("application/http")}
        start, split = origin["head"], "warc-segment-number" in head
        revisit = start.get("warc-type") == "revisit"
        ends = not split or "warc-segment-total-length" in head
        body, size, before = bytearray(), 0, bytearray()

        def row(last: bool, size: int, body: bytes, lost: str | None = lost, start: dict = start, revisit: bool = revisit, origin: dict = origin) -> dict:
            origin["chunk"] += 1
            digest, declared = base64.b32encode(origin["digest"].digest()).decode(), start.get("warc-payload-digest", "").removeprefix("sha1:")
            return {
                "record_id": start.get("warc-record-id", "").strip("<>"), "chunk": origin["chunk"], "page_id": int(start["x-page-id"]) if "x-page-id" in start else None, "record_type": start.get("warc-type", ""),
                "refers_to": int(start["x-refers-to-page-id"]) if "x-refers-to-page-id" in start else None, "payload": body if with_payload and not revisit else None, "chunk_bytes": size, "last": last,
                "payload_bytes": int(start["x-payload-length"]) if revisit and "x-payload-length" in start else origin["bytes"], "payload_digest": declared if revisit else digest, "archive": None,
                "error": lost or ("payload digest differs" if last and not revisit and declared and digest != declared else None),
            }

        for part in stream.take(left):
            if origin["http"]:  # what comes before the blank line is not payload
                before += part
                cut_ = before.find(b"\r\n\r\n")
                if cut_ < 0:
                    continue
                part, origin["http"] = bytes(before[cut_ + 4 :]), False
                before.clear()
            while part:
                if size == chunk_bytes:
                    yield row(False, size, bytes(body))
                    body.clear()
                    size = 0
                some, part = part[: chunk_bytes - size], part[chunk_bytes - size :]
                origin["digest"].update(some)
                origin["bytes"] += len(some)
                size += len(some)
                if with_payload:
                    body += some
        yield row(ends, size, bytes(body))


_ROW = pa.schema([("record_id", pa.string()), ("chunk", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("chunk_bytes", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.int64()), ("error", pa.string())])
_DDL = "record_id string, chunk int, page_id bigint, record_type string, refers_to bigint, payload binary, chunk_bytes bigint, last boolean, payload_bytes bigint, payload_digest string, archive bigint, error string"


def read(spark: SparkSession, path: str, with_payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives in a folder.

    ``payload_bytes`` and ``payload_digest`` of a row are those of the payload up to and with its chunk; for a revisit
    they are the declared ones of the payload that it refers to.
    """

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path)
    streams = found.select("path").limit(1).collect()
    by_path = not streams or _known(streams[0].path)

    def blocks(place: str, content: bytes | None) -> Iterator[bytes]:
        with io.BytesIO(content) if content is not None else archives.opened(place) as f:
            while data := f.read(READ_BYTES):
                yield data

    def run(batches):
        for b in batches:
            for place, archive, *content in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                rows, held = [], 0
                for row in parse(unzipped(blocks(place, content[0] if content else None)), with_payload, chunk_bytes=chunk_bytes):
                    rows.append(row | {"archive": archive})
                    held += len(row["payload"] or b"")
                    if len(rows) >= 1000 or held > 4 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)

    names = found.select("path", F.xxhash64("path").alias("archive"), *([] if by_path else ["content"]))
    return names.mapInArrow(frugal(run), _DDL)


def _known(path: str) -> bool:
    try:
        archives.store_of(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).where("last or error is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM f"""
}
