"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped

#: Edges up to which a round's minima are broadcast; beyond it adaptive execution splits what a hub has.
BROADCAST_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b; the result has node and root (the smallest node that it reaches).

    Every node of an edge is in the result. Neighbours are only aggregated to their minimum, never gathered,
    so the hub of a large group costs a row for each edge. Each round is a stored table, and the table of the round before
    is removed.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while True:
        # a hub would be one task of a join that deals by nodes
        sent = F.broadcast if state[0] <= BROADCAST_EDGES else lambda x: x
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        # every neighbour above a node joins the least of that node and its neighbours, and so does the node
        large = now.join(sent(least.withColumnRenamed("u", "v")), "v").select("u", F.col("m").alias("v"))
        large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(lowest), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        dropped(last)
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) of a graph brought up to date with more edges, by the components of the contracted graph.

    Nodes that ``roots`` lacks are roots of themselves.
    """
    end = lambda e: F.coalesce(F.col(f"r{e}"), F.col(e)).alias(e)
    known = lambda e: roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}"))
    between = edges.join(known("a"), "a", "left").join(known("b"), "b", "left").select(end("a"), end("b")).where("a != b")
    above = components(between)
    up = above.select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(old.unionByName(above.join(roots, "node", "left_anti").select("node", "root")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first())
