"""Sector chains of compound files, put in order by pointer jumping.

A compound file says for each sector which comes next. Walking a chain takes as many steps as it has sectors; here each sector points to the
one before it, then, round by round, twice as far, so that a chain of n sectors is in order after about log2(n) joins over all
files at once. A file takes part in as many rounds as its own sectors need; of those that are done nothing is exchanged or written any more.
Sectors that still point somewhere when every chain of that many sectors must have come to its first one run in a circle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import binary
from textloom.sources import shared

CIRCLE, LOST, SHARED = "a chain of sectors runs in a circle", "a sector is not in the table", "two chains meet in a sector"
#: Where a chain ends, the least number that is no sector, and free or reserved sectors.
_END, _NO_SECTOR, _NOT_IN_CHAINS = 0xFFFFFFFE, 0xFFFFFFFA, (0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC)


def chains(links: DataFrame) -> DataFrame:
    """file, first, position, sector, error for links of (file, sector, next), next being null at the end of a chain.

    ``first`` is the chain's first sector and ``position`` counts from 0. A file of which something is wrong has a row for each kind of fault
    (with ``error`` alone): a circle, whose sectors have no position; a next that is no sector of the file; a sector that two others name,
    which follows the smaller one. Rows without a file or sector are left out; repeated rows count once.
    """
    links = links.select("file", *(F.col(c).cast("bigint").alias(c) for c in ("sector", "next"))).where("file IS NOT NULL AND sector IS NOT NULL")
    # a sector meets all that name it in one exchange
    ends = F.array(F.struct("sector", F.lit(None).cast("bigint").alias("before"), F.lit(True).alias("known")), F.struct(F.col("next").alias("sector"), F.col("sector").alias("before"), F.lit(False).alias("known")))
    seen = links.select("file", F.inline(ends)).where("sector IS NOT NULL")
    seen = shared.stored(seen.groupBy("file", "sector").agg(F.min("before").alias("before"), (F.min("before") != F.max("before")).alias("shared"), F.max("known").alias("known")), "seen")
    known = seen.where("known").select("file", "sector", F.col("before").alias("jump"), F.when(F.col("before").isNull(), F.col("sector")).alias("first"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("position"))
    # after so many rounds no chain of a file of so many sectors goes on
    rounds = known.groupBy("file").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("rounds"))
    state = shared.stored(known.join(rounds, "file"), "ranks")
    most, done, at = state.agg(F.max("rounds")).first()[0] or 0, [state.where("rounds = 0")], 0
    while at < most:
        # files that are done are written no more
        state, at = state.where(F.col("rounds") > at), at + 1
        ahead = state.select("file", F.col("sector").alias("jump"), F.col("jump").alias("jump2"), F.col("first").alias("first2"), F.col("position").alias("position2"))
        moved = state.where("jump IS NOT NULL").join(ahead, ["file", "jump"], "left").select("file", "sector", F.col("jump2").alias("jump"), F.col("first2").alias("first"), (F.col("position") + F.coalesce("position2", F.lit(0))).alias("position"), "rounds")
        state = shared.stored(state.where("jump IS NULL").unionByName(moved), "ranks")
        done.append(state.where(F.col("rounds") == at))
    state = reduce(DataFrame.unionByName, done)
    told = lambda rows, error: rows.select("file").distinct().select("file", F.lit(error).alias("error"))
    faults = [told(state.where("jump IS NOT NULL"), CIRCLE), told(seen.where("NOT known"), LOST), told(seen.where("shared"), SHARED)]
    errors = reduce(DataFrame.unionByName, faults)
    null = lambda name: F.lit(None).cast("bigint").alias(name)
    good = state.where("jump IS NULL").select("file", F.col("first").cast("bigint").alias("first"), "position", F.col("sector").cast("bigint").alias("sector"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors.select("file", null("first"), null("position"), null("sector"), "error"))


def _number(raw: Column, at: Column) -> Column:
    """An unsigned number of four bytes, little-endian, from an offset."""
    digits = F.hex(F.substring(raw, at + 1, F.lit(4)))
    return F.conv(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("bigint")


def _numbers(raw: Column, count: Column) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: _number(raw, 4 * i))).otherwise(F.array().cast("array<bigint>"))


def fat_links(files: DataFrame) -> DataFrame:
    """file, sector, next of each compound file of ``files`` (path, content), from its sector tables, by expressions.

    Tables that the header names are 109 sectors; the further ones stand in a chain of their own, which is followed within its row up to
    as many sectors as the file has. What is no compound file has no links.
    """
    content = F.col("content")
    head = files.where(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1").select("path", "content", binary.little_endian(content, 30, 2).alias("shift"), binary.little_endian(content, 68, 4).alias("further"))
    head = head.where("shift BETWEEN 7 AND 16").withColumn("size", F.expr("shiftleft(1, cast(shift AS INT))"))
    sector = lambda n: F.substring(content, ((n + 1) * F.col("size") + 1).cast("int"), F.col("size"))
    known = F.filter(_numbers(F.substring(content, 77, 436), F.lit(109)), lambda n: n < _NO_SECTOR)
    per = (F.col("size") / 4).cast("int")

    def step(state: Column, _: Column) -> Column:
        numbers = _numbers(sector(state["at"]), per)
        more = F.struct(F.element_at(numbers, -1).alias("at"), F.concat(state["tables"], F.filter(F.slice(numbers, F.lit(1), per - 1), lambda n: n < _NO_SECTOR)).alias("tables"))
        return F.when(state["at"] < F.octet_length(content) / F.col("size") - 1, more).otherwise(state)

    start = F.struct(F.col("further").alias("at"), F.array().cast("array<bigint>").alias("tables"))
    steps = F.sequence(F.lit(1), F.least(binary.little_endian(content, 72, 4), F.octet_length(content) / F.col("size")).cast("int"))
    further = F.when((F.col("further") < _NO_SECTOR) & (binary.little_endian(content, 72, 4) > 0), F.aggregate(steps, start, step, lambda s: s["tables"])).otherwise(F.array().cast("array<bigint>"))
    # only the tables' own bytes leave the row of the file
    tables = F.transform(F.concat(known, further), sector)
    raw = head.select("path", per.alias("per"), F.posexplode(tables).alias("table", "raw"))
    count = F.least(F.col("per"), (F.octet_length("raw") / 4).cast("int"))
    numbers = raw.select("path", F.col("table").cast("bigint").alias("table"), "per", F.posexplode(_numbers(F.col("raw"), count)).alias("at", "next"))
    links = numbers.where(~F.col("next").isin(*_NOT_IN_CHAINS)).select(F.col("path").alias("file"), (F.col("table") * F.col("per") + F.col("at")).alias("sector"), F.when(F.col("next") != _END, F.col("next")).alias("next"))
    return links


def sectors(files: DataFrame) -> DataFrame:
    """file, first, position, sector, error: every chain of every compound file in order."""
    return chains(fat_links(files))
