"""Connected components of a graph of ids, by alternating large-star and small-star steps.

Every step is a grouping and a join; each round's edges are a table in the shared folder. A hub's edges are split
by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "node")
    out = both.join(least, both["a"] == least["node"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.filter("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
    out = edges.join(least, edges["a"] == least["node"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.union(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least id that the node reaches) of all nodes that have an edge to another one.

    Edges are pairs of whole numbers in any order; repeated ones, loops and nulls are harmless.
    """
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = stored(pairs.distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = stored(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
