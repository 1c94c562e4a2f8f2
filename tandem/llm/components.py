"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tandem.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``u``; partial sums make a hot ``u`` harmless."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (u, v) reach, for each node that has an edge to another.

    Every round moves each node's links to the least node of its neighbourhood; the number of rounds grows with the
    logarithm of the longest path.  A round is one written table, so a lost executor costs at most a round.  Edges
    with a null end and loops take no part; repeated edges count once.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        linked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = Observation()  # counted while the round's table is written
        e = written(e.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        if state.get == seen:
            break
        seen = state.get
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
