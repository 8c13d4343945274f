"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in edges (a, b): root is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones, until all
    components are stars; rounds grow with the logarithm of a component's diameter. Edges stay in tables;
    self loops give a node of its own; null ends are dropped; empty input gives no rows."""
    ends = edges.where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    current = written(ends.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = current.union(current.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(low.select("u", F.col("m").alias("v")).union(moved).distinct(), "edges")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots).union(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
