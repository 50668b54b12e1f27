"""Connected components on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.llm.common import cut, join_groups


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a, b: long) with the least node that they reach: node, root.

    Alternating large and small stars: each round hangs neighbours onto the least neighbour, by
    aggregation and joins only, until the edges are stars. Each round is cut into the shared
    checkpoint folder. Least neighbours come by aggregation and are joined as groups, so a hub's edges
    are spread over all tasks. The roots themselves are not listed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = cut(small_star(cut(large_star(now, 2 * state[0]))))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m")))
    tied = join_groups(both.where("b > a"), least, "a", "n", total, F.col("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. After the large stars a node has
    few smaller neighbours; the hubs are on the other side."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
