"""Preference formatting: a prompt rendered once, and paired completions with masks.

For a chosen and a rejected conversation the longest common prefix of turns (equal role and text) is the prompt; the
rest of each is its completion. A turn is rendered as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
feed. The mask of a completion is the spans [start, end), in code points, of the texts of assistant turns with
their end mark: what a model is trained on. Marks inside texts and roles are broken up, so a text cannot forge a turn.

Turns of a pair are gathered by one shuffle; the largest group is the turns of two conversations. Only DataFrame functions
are used.

Defined cases: a null role or text is the empty one; a null turn comes first, turns of equal number come in order of role
and text; repeated rows are one turn; rows without a conversation belong to none and are left out; a pair of which one
conversation has no turns has an empty prompt and an empty completion there; conversations that are equal have two empty
completions; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def _plain(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _prefix(a: Column, b: Column) -> Column:
    """The number of turns that two conversations have in common at the start."""
    shared = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shared), F.slice(b, 1, shared), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, shared).otherwise(first - 1)


def _mask(turns: Column) -> Column:
    """Spans of the trained parts of rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, turn):
        head = state["at"] + F.char_length(turn["role"]) + len(START) + 1
        end = head + F.char_length(turn["text"]) + len(END)
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(F.struct(head.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each row of ``pairs`` (pair_id, chosen, rejected: ids of conversations): pair_id, n_prefix, prompt, chosen,
    rejected, chosen_mask, rejected_mask."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected").alias("conv_id")))).alias("s")).select("pair_id", "s.*")
    return _formatted(sides.join(turns.select("conv_id", "turn", "role", "text"), "conv_id", "left"))


def _formatted(rows: DataFrame) -> DataFrame:
    """From one row for each pair, side and turn; a side without turns has a row with conv_id only or none."""
    turn = F.struct("turn", _plain(F.col("role")).alias("role"), _plain(F.col("text")).alias("text"))
    some = F.col("turn").isNotNull() | F.col("role").isNotNull() | F.col("text").isNotNull()
    # array_sort puts null fields first; collect_set leaves repeated rows out
    sides = [F.array_sort(F.collect_set(F.when((F.col("side") == k) & some, turn))).alias(name) for k, name in ((0, "a"), (1, "b"))]
    both = rows.groupBy("pair_id").agg(*sides).withColumn("n", _prefix(F.col("a"), F.col("b")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    both = both.withColumn("x", rest(F.col("a"))).withColumn("y", rest(F.col("b")))
    text = lambda x: F.array_join(F.transform(x, _rendered), "")
    return both.select("pair_id", F.col("n").alias("n_prefix"), text(F.slice("a", 1, F.col("n"))).alias("prompt"), text(F.col("x")).alias("chosen"), text(F.col("y")).alias("rejected"), _mask(F.col("x")).alias("chosen_mask"), _mask(F.col("y")).alias("rejected_mask"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k, whole table."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    rows = turns.select(F.expr("conv_id div 2 - if(conv_id < 0 and pmod(conv_id, 2) = 1, 1, 0)").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return _formatted(rows).select("pair_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


QUERIES = {"op8_preferences": op8_preferences}
ORACLES = {
    "op8_preferences": """
WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id - 2 * CAST(floor(conv_id / 2) AS BIGINT) AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text FROM t),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, a.i IS NOT NULL AND b.i IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
      FROM (SELECT * FROM o WHERE side = 0) a FULL JOIN (SELECT * FROM o WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
n AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM j GROUP BY pair_id),
r AS (SELECT o.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM o JOIN n USING (pair_id)),
m AS (SELECT *, coalesce(sum(length(s)) FILTER (i > n) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS head FROM r)
SELECT pair_id, CAST(min(n) AS INTEGER) AS n_prefix, coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen, coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(head AS BIGINT) || '-' || CAST(head + length(text) + 10 AS BIGINT), ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(head AS BIGINT) || '-' || CAST(head + length(text) + 10 AS BIGINT), ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id"""
}
