"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line; its leaves are runs of text up to and with sentence marks and commas and the spaces after
them. A paragraph's hash is that of its leaves' hashes. A section is a run of paragraphs that ends with one whose hash
starts with 0 or 1, so that its borders depend on content and an edit moves them only near by. The root is the
hash of the sections' hashes.

A fingerprint is ``root:sections``: sections are separated by ``|``, paragraphs by a space, and a paragraph is
the first eight hexadecimal digits of each leaf. Roots test equality of whole texts; where they differ,
``differing`` names the sections of one text that the other lacks, and ``likeness`` is the share of leaves in
common, 2 |a & b| / (|a| + |b|) over distinct leaves.

``neighbours`` gives each document the next one in descending order without a sort of the whole table: ids are cut
into buckets of about ``BUCKET_ROWS`` rows by their quantiles, each bucket is one window, and the first row of the
next bucket stands at its end as a row of its own. Only DataFrame functions are used.

Defined cases: a null text is the empty text; a null doc_id comes after all others; rows with equal ids come in
descending order of text, and repeated rows each give a row; the only row is its own next; two texts without
leaves are alike (1), with one without leaves not (0); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 14
LEAF = r"[^.,!?]*[.,!?]+ *|[^.,!?]+"


def tree(text: Column) -> Column:
    """For each paragraph the hashes of its leaves."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x.cast("binary"))))


def _hash(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, "").cast("binary"))


def _marked(paragraph: Column, shown: Column) -> Column:
    """What is shown of a paragraph, with the mark of its border: ``|`` ends a section."""
    return F.concat(shown, F.when(_hash(paragraph).substr(1, 1).isin("0", "1"), F.lit("|")).otherwise(F.lit(" ")))


def leaves(paragraphs: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(paragraphs), lambda x: F.substring(x, 1, 8)))


def fingerprint(paragraphs: Column) -> Column:
    sections = F.split(F.array_join(F.transform(paragraphs, lambda p: _marked(p, _hash(p))), ""), r"\|")
    root = F.sha2(F.array_join(F.transform(sections, lambda s: F.md5(s.cast("binary"))), "").cast("binary"), 256)
    shown = F.array_join(F.transform(paragraphs, lambda p: _marked(p, F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), ""))), "")
    return F.concat(root, F.lit(":"), shown)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of distinct leaves."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def leaves_of(print_: Column) -> Column:
    """The distinct leaves that a fingerprint shows."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0)))


def differing(print_: Column, other: Column) -> Column:
    """Numbers, from 0, of the sections of one fingerprint that the other lacks; empty if the roots are equal."""
    sections = lambda x: F.split(F.substring_index(x, ":", -1), r"\|")
    numbered = F.transform(sections(print_), lambda s, i: F.when(~F.array_contains(sections(other), s), i))
    return F.when(F.substring_index(print_, ":", 1) == F.substring_index(other, ":", 1), F.array().cast("array<int>")).otherwise(F.filter(numbered, lambda i: i.isNotNull()))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below an id, by two steps through a nested literal; -1 for null."""
    fan = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    array = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")
    nested = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < doc_id))
    # the last bound of a group is below the id: the whole group is
    whole = below(array([g[-1] for g in groups]))
    inside = F.when(whole < len(groups), below(F.get(nested, whole))).otherwise(0)
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(whole * fan + inside)


def neighbours(docs: DataFrame, carry: dict[str, callable] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text (never null), next_text, and for each of ``carry`` a column of the text and next_<name>."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = min(MOST_BUCKETS, max(1, n // bucket_rows))
    bounds = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * parts)).alias("b")).first().b or []))
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds) if bounds else F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    # the first row of each bucket stands, as a row without an id, at the end of the bucket before
    firsts = cut(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("first")))
    there = sorted((r.bucket for r in firsts.select("bucket").collect()), reverse=True)
    follow = rows.sparkSession.createDataFrame([(there[i], there[i - 1]) for i in range(len(there))], "bucket int, before int")
    ends = firsts.join(F.broadcast(follow), "bucket").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("first.text").alias("text"), F.col("before").alias("bucket"), F.lit(1).alias("end"))
    dealt = rows.withColumn("end", F.lit(0)).unionByName(ends).repartition("bucket")
    for name, make in (carry or {}).items():
        dealt = dealt.withColumn(name, make(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("end", F.desc_nulls_last("doc_id"), F.desc("text"))
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *(carry or {}))]
    return dealt.select("*", *nexts).where("end = 0").drop("end", "bucket")


def edited(text: Column, next_text: Column, n: Column) -> Column:
    """The text with its last third of code points replaced by as many first ones of another."""
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - third), F.left(next_text, third))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours(table(spark, sf_dir, "documents"), {"tree": tree})
    rows = rows.withColumn("n", F.char_length("text")).withColumn("edited", edited(F.col("text"), F.col("next_text"), F.col("n")))
    rows = rows.select("doc_id", "n", "edited", "tree", tree(F.col("edited")).alias("other"), leaves(F.col("next_tree")).alias("next")).withColumn("own", leaves(F.col("tree")))
    return rows.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), leaves(F.col("other"))).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def _sql(x: str) -> dict[str, str]:
    mark = f"concat({{}}, CASE WHEN substr(md5(array_to_string(p, '')), 1, 1) IN ('0', '1') THEN '|' ELSE ' ' END)"
    hashes = f"array_to_string(list_transform({x}, lambda p: {mark.format(chr(109) + 'd5(array_to_string(p, ' + chr(39) * 2 + '))')}), '')"
    shown = f"array_to_string(list_transform({x}, lambda p: {mark.format('array_to_string(list_transform(p, lambda l: l[1:8]), ' + chr(39) * 2 + ')')}), '')"
    root = f"sha256(array_to_string(list_transform(string_split({hashes}, '|'), lambda s: md5(s)), ''))"
    return {"print": f"concat({root}, ':', {shown})", "leaves": f"list_distinct(list_transform(flatten({x}), lambda l: l[1:8]))"}


def _near(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _tree_sql(t: str) -> str:
    return f"list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: md5(l)))"


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLES = {
    "op2_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t DESC)),
e AS (SELECT *, concat(substr(t, 1, n - n // 3), substr(nt, 1, n // 3)) AS e FROM o),
h AS (SELECT doc_id, n, e, {_tree_sql("t")} AS x, {_tree_sql("e")} AS y, {_tree_sql("nt")} AS z FROM e),
l AS (SELECT doc_id, n, e, {_sql("x")["print"]} AS f, {_sql("y")["print"]} AS g, {_sql("x")["leaves"]} AS lx, {_sql("y")["leaves"]} AS ly, {_sql("z")["leaves"]} AS lz FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint, {_near("lx", "ly")} AS near_edited, {_near("lx", "lz")} AS near_next FROM l"""
}
