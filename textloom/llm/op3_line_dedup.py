"""Site-relative line dedup: lines that too large a share of a host's pages contain are dropped.

For each host the pages that contain a line are divided by the host's pages; a line is boilerplate when the ratio
exceeds ``RATIO``, whatever the number of pages. A line that one page alone has repeats nothing and stays. Counting takes each line of a page once and
pre-aggregates before the shuffle, so a hot host or line costs no task more than others. A host has at most (mean distinct lines of a page) /
ratio boilerplate lines, so they are one small row for each host. All hosts' rows together are broadcast only up to
``BROADCAST_LINES`` lines; beyond it they are joined by host, with the pages of a host dealt to ``SALTS`` parts by their place in the table, so that copies
of one page are dealt too. A page's lines are looked up in its host's by hash, once a page.

Lines are compared without spaces, tabs and carriage returns at their ends; blank lines are never dropped.
Only DataFrame functions are used.

Defined cases: a null text has no lines and stays null; an empty text has one blank line; a null host is the host
of the empty name; repeated rows are pages of their own; extra columns are ignored by ``clean_lines`` and kept by
``drop_boilerplate``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

RATIO = 0.1
BROADCAST_LINES = 200_000
SALTS = 32


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(text: Column) -> Column:
    """Hashes of the distinct lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: _bare(x) != ""), lambda x: F.xxhash64(_bare(x))))


def boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source") -> DataFrame:
    """host and lines: hashes of the boilerplate lines of each host that has any."""
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), _hashes(F.col("text")).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    return counts.join(totals, "host").where(F.col("n") > F.col("pages") * ratio).groupBy("host").agg(F.collect_set("line").alias("lines"))


def _with_lines(docs: DataFrame, found: DataFrame, host: str, here: str, broadcast_lines: int) -> DataFrame:
    """``docs`` with those lines in the column ``here`` that are boilerplate of their host; null if the host has none."""
    name, lines, salt, other = fresh(docs, "host_", "lines_", "salt_", "other_")
    found = cut(found.select(F.col("host").alias(name), F.col("lines").alias(lines)))
    key = F.coalesce(docs[host], F.lit(""))
    if (found.agg(F.sum(F.size(lines))).first()[0] or 0) <= broadcast_lines:
        joined = docs.join(F.broadcast(found), key == F.col(name), "left")
    else:
        dealt = docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = found.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(copies, (F.coalesce(dealt[host], F.lit("")) == F.col(name)) & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    return joined.withColumn(here, F.array_intersect(_hashes(docs["text"]), F.col(lines))).drop(name, lines)


def _is_kept(line: Column, here: str) -> Column:
    return (_bare(line) == "") | ~F.array_contains(F.col(here), F.xxhash64(_bare(line)))


def _clean(text: Column, here: str) -> Column:
    return F.when(F.col(here).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: _is_kept(x, here)), "\n"))


def clean_lines(docs: DataFrame, ratio: float = RATIO, host: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, n_lines, n_dropped, clean_text: one row for each row of ``docs``."""
    rows = docs.select("doc_id", "text", host)
    joined = _with_lines(rows, boilerplate(rows, ratio, host), host, "here_", broadcast_lines)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    gone = F.when(F.col("text").isNull() | F.col("here_").isNull(), 0).otherwise(F.size(F.filter(F.split("text", "\n"), lambda x: ~_is_kept(x, "here_")))).cast("bigint")
    return joined.select("doc_id", n.alias("n_lines"), gone.alias("n_dropped"), _clean(F.col("text"), "here_").alias("clean_text"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All rows and columns of ``docs``, with boilerplate taken out of ``text`` and ``n_chars`` to match."""
    (here,) = fresh(docs, "here_")
    joined = _with_lines(docs, boilerplate(docs, ratio, host), host, here, broadcast_lines)
    text = _clean(F.col("text"), here)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(here).isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"))


LINES_SQL = """
{name}_l AS (SELECT doc_id, source, text, i, list_extract(ls, i) AS line, trim(list_extract(ls, i), ' ' || chr(9) || chr(13)) AS bare
      FROM (SELECT doc_id, source, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, coalesce(source, '') AS source, text, string_split(text, chr(10)) AS ls FROM {docs}) WHERE text IS NOT NULL)),
{name}_b AS (SELECT c.source, c.bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS n FROM {name}_l WHERE bare <> '' GROUP BY ALL) c
      JOIN (SELECT coalesce(source, '') AS source, count(*) AS pages FROM {docs} GROUP BY 1) h ON h.source = c.source WHERE n > 1 AND n > pages * 0.1),
{name}_k AS (SELECT {name}_l.*, {name}_b.bare IS NOT NULL AS gone FROM {name}_l LEFT JOIN {name}_b ON {name}_b.source = {name}_l.source AND {name}_b.bare = {name}_l.bare),
{name}_a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean_text FROM {name}_k GROUP BY doc_id)"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": "WITH "
    + LINES_SQL.format(name="x", docs="documents")
    + """
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, clean_text FROM documents d LEFT JOIN x_a a USING (doc_id)"""
}
