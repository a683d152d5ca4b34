"""Connected components by alternating large and small stars, each round a Spark job over the edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm import common


def _star(edges: DataFrame, count: int, large: bool) -> DataFrame:
    """large: links every larger neighbour of a node to its smallest neighbour; small: every smaller one, and the node."""
    if large:
        edges, count = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * count
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    joined = common.join_hot(edges, least, "a", count)  # a star's centre has as many edges as its component
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Rows node, root for each node of the edges (a, b), roots included; root is the component's smallest node.

    Edges of any order and repeats are taken, loops and nulls dropped. The rounds end when no edge changes; as a
    star with its smallest node as centre stays as it is, what changes is told by a count and a sum of hashes.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    with common.scope():
        edges = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        before = mark(edges)
        while before[0]:
            half = common.stored(_star(edges, before[0], True), name)
            edges = common.stored(_star(half, half.count(), False), name)
            after = mark(edges)
            if after == before:
                break
            before = after
        common.keep(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
