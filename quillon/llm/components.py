"""Connected components of an edge table by alternating large and small stars, lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) edges; component is the least node reachable."""
    up = edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    up = checkpoint(up, narrow=True)
    before = None
    while True:
        state = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        # large star: each node sends its larger neighbours to the least of its neighbourhood
        ways = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: each node sends its smaller neighbours and itself to the least of them
        down = large.select(F.col("v").alias("n"), F.col("u").alias("s"))
        root = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(root, "n").where("s <> m").select(F.col("m").alias("u"), F.col("s").alias("v")).unionByName(root.select(F.col("m").alias("u"), F.col("n").alias("v"))).distinct()
        up = checkpoint(small, narrow=True)
    top = up.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return top.unionByName(top.select(F.col("component").alias("node"), "component").distinct())
