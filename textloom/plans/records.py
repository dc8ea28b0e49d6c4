"""Record streams of binary documents as rows, by expressions.

A stream is a run of records: a header that tells kind and length, then so many bytes. Where a record starts is only known once the one
before it is read, so a stream is folded from its start: the state is an offset and a stack of the ends of the containers that are open. What the fold
finds is kept in blocks, so that a stream of n records costs some n steps, and steps end with the stream.

A stream that is damaged gives what could be read and a row with ``error``: a container that passes the end of the one around it is read up to
that end, and a record that does so ends the stream, as does a header that is cut off. Null streams and empty ones have no records.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import binary, textnorm

BEYOND, CUT_OFF = "a record passes the end of what holds it", "a record's header is cut off"
#: Text records of presentations, and what stands in front of a text.
TEXT_CHARS, TEXT_BYTES, C_STRING = 0x0FA0, 0x0FA8, 0x0FBA
PPT_HEADER = "=== 文本内容 ===\n"
#: Records in a block of what the fold has found.
BLOCK = 64

_RECORD = "struct<kind:bigint,instance:bigint,depth:int,offset:bigint,length:bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unsigned(digits: Column, at: int, size: int) -> Column:
    """A little-endian number in the hexadecimal digits of some bytes."""
    swapped = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(at + size - 1, at - 1, -1)))
    return F.conv(swapped, 16, 10).cast("bigint")


def _head(kind: Column, instance: Column, opens: Column, size: Column, head: Column) -> Column:
    return F.struct(kind.alias("kind"), instance.alias("instance"), opens.alias("opens"), size.alias("size"), head.cast("bigint").alias("head"))


def office_art(digits: Column) -> Column:
    """Eight bytes: four bits of version, 15 being a container, twelve of instance, kind and length."""
    head = lambda first: _head(_unsigned(digits, 2, 2), binary.bits(first, 4, 12), binary.bits(first, 0, 4) == 15, _unsigned(digits, 4, 4), F.lit(8))
    return F.when(F.length(digits) >= 16, let(_unsigned(digits, 0, 2), head))


def biff(digits: Column) -> Column:
    """Four bytes: kind and length. No containers."""
    head = _head(_unsigned(digits, 0, 2), F.lit(0).cast("bigint"), F.lit(False), _unsigned(digits, 2, 2), F.lit(4))
    return F.when(F.length(digits) >= 8, head)


def biff12(digits: Column) -> Column:
    """Kind in one or two bytes and length in one to four, of seven bits each; the high bit tells that another follows. No containers."""

    def number(bytes_: Column, most: int) -> Column:
        """Value and number of bytes; null if the last of them is not there."""
        byte = lambda k: F.get(bytes_, F.lit(k))
        value, out = F.lit(0).cast("bigint"), F.lit(None)
        ends = []
        for k in range(most):
            value = value + F.shiftleft(byte(k).bitwiseAND(F.lit(127)), 7 * k)
            ends.append(F.struct(value.alias("value"), F.lit(k + 1).alias("n")))
        for k in range(most - 1, -1, -1):
            last = F.lit(True) if k == most - 1 else byte(k) < 128
            out = F.when(byte(k).isNull(), F.lit(None)).when(last, ends[k]).otherwise(out)
        return out

    def both(bytes_: Column) -> Column:
        return let(number(bytes_, 2), lambda kind: let(number(F.slice(bytes_, kind["n"] + 1, F.lit(4)), 4), lambda size: F.when(size["n"].isNotNull(), _head(kind["value"], F.lit(0).cast("bigint"), F.lit(False), size["value"], kind["n"] + size["n"]))))

    count = (F.length(digits) / 2).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(count >= 2, let(bytes_, lambda b: F.when(number(b, 2).isNotNull(), both(b))))


#: The bytes that hold any header of a layout, and those of its shortest record.
_WIDEST, _SHORTEST = {office_art: 8, biff: 4, biff12: 6}, {office_art: 8, biff: 4, biff12: 2}


def _state(at: Column, ends: Column, found: Column, fault: Column, over: Column) -> Column:
    # no cast of the whole, which would copy all that was found at each step
    return F.struct(at.cast("bigint").alias("at"), ends.alias("ends"), found.alias("found"), fault.cast("string").alias("fault"), over.alias("over"))


def scan(content: Column, layout: Callable[[Column], Column] = office_art) -> Column:
    """``records`` (kind, instance, depth, offset and length of what follows the header) of a stream in order, and ``error``."""
    size = F.octet_length(content).cast("bigint")
    none = F.array().cast(f"array<{_RECORD}>")

    def step(s: Column, _: Column) -> Column:
        ends = F.filter(s["ends"], lambda e: e > s["at"])

        def read(open_: Column, h: Column, b: Column) -> Column:
            room, offset, end = b["room"], b["offset"], b["end"]
            fault = F.coalesce(s["fault"], F.when(end > room, F.lit(BEYOND)))
            length = F.when(h["opens"], F.least(end, room) - offset).otherwise(h["size"])
            one = F.struct(h["kind"].alias("kind"), h["instance"].alias("instance"), F.size(open_).alias("depth"), offset.alias("offset"), length.alias("length"))
            found = F.concat(s["found"], F.array(one))
            into = _state(offset, F.concat(open_, F.array(F.least(end, room))), found, fault, F.lit(False))
            on = _state(end, open_, found, fault, F.lit(False))
            # a header may itself pass the end of what holds it
            stop = _state(s["at"], open_, s["found"], fault, F.lit(True))
            return F.when(F.when(h["opens"], offset).otherwise(end) > room, stop).when(h["opens"], into).otherwise(on)

        def headed(open_: Column) -> Column:
            digits = F.hex(F.substring(content, (s["at"] + 1).cast("int"), F.lit(_WIDEST[layout])))
            cut = _state(s["at"], open_, s["found"], F.coalesce(s["fault"], F.lit(CUT_OFF)), F.lit(True))
            room = F.coalesce(F.get(open_, F.size(open_) - 1), size)
            bounds = lambda h: F.struct(room.alias("room"), (s["at"] + h["head"]).alias("offset"), (s["at"] + h["head"] + h["size"]).alias("end"))
            return let(let(digits, layout), lambda h: F.when(h["head"].isNull(), cut).otherwise(let(bounds(h), lambda b: read(open_, h, b))))

        ended = _state(s["at"], s["ends"], s["found"], s["fault"], F.lit(True))
        return F.when(s["over"], s).when(s["at"] >= size, ended).otherwise(let(ends, headed))

    join = lambda at, ends, blocks, fault, over: F.struct(at.cast("bigint").alias("at"), ends.alias("ends"), blocks.alias("blocks"), fault.alias("fault"), over.alias("over"))

    def block(s: Column, _: Column) -> Column:
        start = _state(s["at"], s["ends"], none, s["fault"], F.lit(False))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), start, step)
        more = let(run, lambda r: join(r["at"], r["ends"], F.concat(s["blocks"], F.array(r["found"])), r["fault"], r["over"]))
        return F.when(s["over"], s).otherwise(more)

    zero = join(F.lit(0), F.array().cast("array<bigint>"), F.array().cast(f"array<array<{_RECORD}>>"), F.lit(None).cast("string"), F.lit(False))
    blocks = F.sequence(F.lit(0).cast("bigint"), (size / (_SHORTEST[layout] * BLOCK)).cast("bigint"))
    return F.when(size > 0, F.aggregate(blocks, zero, block, lambda s: F.struct(F.flatten(s["blocks"]).alias("records"), s["fault"].alias("error"))))


def records(streams: DataFrame, key: str, content: str = "content", layout: Callable[[Column], Column] = office_art, kinds: Sequence[int] | None = None, payload: bool = False) -> DataFrame:
    """key, position, kind, instance, depth, offset, length, error (and raw, the bytes, with ``payload``): a row for each record of each stream.

    ``position`` counts all records from 0, those of other kinds than ``kinds`` too; of a container, ``raw`` is null. What is wrong with a stream is
    a row of its own, with ``error`` alone. Only the bytes of wanted records leave the row of the stream. Other columns are ignored.
    """
    found = streams.select(F.col(key).alias("key"), F.col(content).alias("content")).select("key", "content", scan(F.col("content"), layout).alias("s"))
    wanted = F.transform(F.col("s.records"), lambda r, i: F.struct(i.alias("position"), r.alias("r")))
    if kinds is not None:
        wanted = F.filter(wanted, lambda x: x["r"]["kind"].isin(*kinds))

    def row(x: Column) -> Column:
        r = x["r"]
        inner = F.get(F.col("s.records"), x["position"] + 1)["depth"] > r["depth"]
        raw = F.when(~F.coalesce(inner, F.lit(False)), F.substring(F.col("content"), (r["offset"] + 1).cast("int"), r["length"].cast("int")))
        fields = [x["position"].cast("bigint").alias("position"), *(r[c].alias(c) for c in ("kind", "instance", "depth", "offset", "length")), F.lit(None).cast("string").alias("error")]
        return F.struct(*fields, *([raw.alias("raw")] if payload else []))

    kind = "struct<position:bigint,kind:bigint,instance:bigint,depth:int,offset:bigint,length:bigint,error:string" + (",raw:binary>" if payload else ">")
    null = lambda t: F.lit(None).cast(t)
    told = F.struct(*((F.col("s.error") if n == "error" else null(t)).alias(n) for n, t in (f.split(":") for f in kind[7:-1].split(","))))
    rows = F.concat(F.transform(wanted, row).cast(f"array<{kind}>"), F.when(F.col("s.error").isNotNull(), F.array(told)).otherwise(F.array()).cast(f"array<{kind}>"))
    return found.select("key", F.inline(rows)).withColumnRenamed("key", key)


def text_atoms(streams: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, position, kind, depth, offset, length, text, error: the text records of presentation streams, decoded as they are."""
    rows = records(streams, key, content, kinds=(TEXT_CHARS, TEXT_BYTES, C_STRING), payload=True)
    text = F.when(F.col("kind") == TEXT_BYTES, F.decode("raw", "ISO-8859-1")).otherwise(binary.utf16_text(F.col("raw")))
    return rows.select(key, "position", "kind", "depth", "offset", "length", text.alias("text"), "error")


def presentation_text(content: Column) -> Column:
    """The text of a presentation stream: each text record that is not blank under a heading."""
    s = scan(content)
    kept = F.filter(s["records"], lambda r: r["kind"].isin(TEXT_CHARS, TEXT_BYTES, C_STRING))

    def text(r: Column) -> Column:
        raw = F.substring(content, (r["offset"] + 1).cast("int"), r["length"].cast("int"))
        decoded = F.when(r["kind"] == TEXT_BYTES, F.decode(raw, "ISO-8859-1")).otherwise(binary.utf16_text(raw))
        return textnorm.trim_space(F.translate(decoded, "\r\x0b", "\n\n"))

    blocks = F.transform(F.filter(F.transform(kept, text), lambda t: t != ""), lambda t: F.concat(F.lit(PPT_HEADER), t, F.lit("\n\n")))
    return F.when(content.isNotNull(), F.coalesce(F.array_join(blocks, ""), F.lit("")))
