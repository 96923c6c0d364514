"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (the least node reachable) of every node of the edges (a, b: long). Loops only name a node.

    No node's neighbours are gathered: each step takes the least neighbour by a partial aggregate and joins it back. The least
    neighbours are written first, so that Spark can split the join of a node with many. Every step is written, so a lost executor costs one step.
    Edges that are stars already take no step.

    Defined cases: rows with a null end are left out; repeated edges and both directions of one count once; an empty table has no nodes.
    """
    edges = edges.filter("a is not null and b is not null")
    edge = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = edge.select("u").union(edge.select("v")).distinct().select(F.col("u").alias("node"))
    edge = edge.filter("u != v")
    for _ in range(most_rounds):
        # Stars are what the steps end in: no node with two lesser neighbours, none with both a lesser and a greater one.
        ends = edge.select(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper")).union(edge.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper")).filter("lower + upper > 1 and lower > 0").isEmpty():
            break
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        edge = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = written(edge.groupBy("u").agg(F.min("v").alias("m")), "least")
        lower = edge.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = written(lower.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    root = edge.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
