"""Connected components of an edge table: alternating large-star and small-star steps.

Labels move by joins and aggregates only; each step is written to the shared folder. A vertex
with a third of all edges is no single group: stars are joined with their (aggregated) smallest
neighbour, and the join splits hot keys under adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailcast.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Edges may repeat or join a node to itself; rows with a null end are ignored. An empty table
    gives an empty result. Nodes without edges are left to the caller.
    """
    now = common.write_table(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
                             .where("u is not null and v is not null and u <> v").distinct())
    mark = None
    while True:
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = common.write_table(small.where("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), F.col("component").alias("component")).distinct()
    return stars.unionByName(roots)
