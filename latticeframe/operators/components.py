"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.plans.lineage import materialise


#: Edges up to which a round is one job.
SMALL = 1000


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    Alternates two star steps until no edge changes: the first links every larger neighbour of a node to the smallest
    node around it, the second every smaller neighbour. Both are joins with a per-node minimum, so no node's
    neighbours are ever gathered in one place; the number of rounds grows with the logarithm of the graph.
    Loops and repeated edges are allowed. An empty table gives no rows.
    """
    pairs = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now, seen = materialise(pairs, "edges"), None
    while (state := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen:
        seen = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node may have a third of all edges: joins of plain tables are ones whose large keys Spark can split
        plain = materialise if state[0] > SMALL else lambda df, _: df
        least = plain(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = plain(large, "large")
        lowest = plain(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
