"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, with_groups


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Each round joins the edges with the minima of their nodes and keeps the distinct ends,
    until every edge points at its root. Rounds are checkpointed in the shared folder, so a
    lost executor costs a task, not the lineage. Null ends and loops are ignored. The minimum
    of a star's centre reaches its edges by broadcast if it has many (see
    :func:`~assayer.llm.common.with_groups`), so no task reads a whole star.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        large = with_groups(both, ["u"], [F.min("v").alias("m")], 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = with_groups(large, ["u"], [F.min("v").alias("m")], n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low).distinct()
        e = cut(small)
        # done when no root of an edge is itself hung below another node
        if e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty() and e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
