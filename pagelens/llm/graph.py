"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge list; root is the smallest node that can be reached.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to its smallest neighbour, until the
    edges are stars around the roots. Each step is a grouped minimum and a join on the node, so the neighbours of a hub are
    never gathered; adaptive execution splits the hub's rows. Steps are checkpointed. Nulls are no nodes; loops and repeated
    edges change nothing; an empty list gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    e = settled(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        e = both.filter("v > u").join(least, "u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct()  # larger neighbours to the minimum
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = settled(e.filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
