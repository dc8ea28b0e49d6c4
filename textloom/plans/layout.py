"""Lines of text from fragments with positions, by gaps and islands over windows.

A page's fragments come in the order in which they were drawn. Down the page, a new line begins where the base line falls by more than a share of
the letters' height; along a line, a fragment that begins beyond the end of the one before is a word of its own, and beyond a wider gap a
column. Every step is a window over one page or one line, so documents of any length are spread by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the letters' height: a fall that begins a line, a gap between words, a gap between columns.
LINE_FALL, WORD_GAP, COLUMN_GAP = 0.5, 0.15, 2.0


def text_lines(fragments: DataFrame, doc: str = "doc", line_fall: float = LINE_FALL, word_gap: float = WORD_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """doc, page, line (from 1, from the top), text, y for fragments of (doc, page, x, y, width, height, text); y grows upwards.

    Words are parted by a space and columns by a tab. Base lines that each fall a little and together a lot (a rising or slanted line) stay
    one line. Fragments that lie at the same place come in order of their text; those without text or position are left out; a null width or height
    is 0; repeated rows are each drawn.
    """
    drawn = fragments.where("text <> '' AND x IS NOT NULL AND y IS NOT NULL").select(F.col(doc).alias("doc"), "page", "x", "y", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"), "text")
    down = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x", "text", "width", "height")
    falls = F.coalesce(F.lag("y").over(down) - F.col("y"), F.lit(0.0)) > line_fall * F.col("height")
    numbered = drawn.withColumn("falls", falls.cast("int")).withColumn("line", 1 + F.sum("falls").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("doc", "page", "line").orderBy("x", "text", F.desc("y"), "width", "height")
    # an earlier fragment may reach further than the last one
    gap = F.col("x") - F.max(F.col("x") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = F.when(gap > column_gap * F.col("height"), "\t").when(gap > word_gap * F.col("height"), " ").otherwise("")
    placed = numbered.select("doc", "page", "line", "y", F.row_number().over(along).alias("at"), F.concat(parted, "text").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("at", "piece")))
    lines = placed.groupBy("doc", "page", "line").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"), F.max("y").alias("y"))
    return lines.withColumnRenamed("doc", doc)
