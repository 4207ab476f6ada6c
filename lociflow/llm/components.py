"""Connected components by alternating large-star and small-star steps, on DataFrames only.

Every step is a grouped minimum (combined before its shuffle), written, and a join with it. Both sides of that join are
plain shuffles, so Spark splits a vertex with very many neighbours like any skewed join key; no neighbour list is ever
gathered. Components shrink to stars around their smallest vertex in a number of rounds that grows with the logarithm
of their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m")))
    return both.join(least, F.col("u") == F.col("hub")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub"))
    moved = down.join(least, F.col("u") == F.col("hub")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("hub", "m"))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every vertex of the undirected edges (a, b); root is the component's smallest vertex.

    Edges with a null end and loops connect nothing and are left out; repeated edges count once. No edges: no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = written(_distinct(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    state = _state(now)
    while state[0]:
        now = written(_distinct(_small_star(written(_distinct(_large_star(now))))))
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
