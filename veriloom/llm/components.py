"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import save


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and component, the least id reachable, of all ids in a table with columns a and b.

    Large-star links each vertex's larger neighbours to the least of its neighbourhood, small-star does so with its
    smaller ones; the edges end as stars around the least ids. Each round is two aggregations by vertex and joins on
    it, in the number of edges; the number of rounds grows with the logarithm of the size of a component. Edges are
    kept in the shared folder between rounds; the driver sees two numbers a round.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("m"))
        large = both.join(low, F.col("a") == F.col("v")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below.withColumnRenamed("a", "v"), F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        small = small.unionByName(below.select("a", F.col("m").alias("b"))).distinct()
        edges = save(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
