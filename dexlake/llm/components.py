"""Connected components by alternating large-star and small-star contractions.

Links stay in DataFrames all the way: each round is two grouped minimums and two joins, written to the shared folder.  A round of
both at least halves long chains, so the rounds grow with the logarithm of the longest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import cut, drop


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v: the same orderable type); component is its least node.

    Links of a node to itself and repeated links don't matter.  Nodes without a link aren't returned.
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before, last = state, edges
        edges = cut(_small(_large(edges)))
        drop(last)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
