"""Connected components of a link table, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without links are absent.

    Each round hooks a node and its present root to the smallest root among its neighbours, then
    follows roots once; rounds grow with the logarithm of a component's length.  Every join reads
    written tables on both sides, so that AQE can split the rows of a node with very many links.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = keep(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = keep(edges.groupBy("x").agg(F.min("y").alias("_m")).select(F.col("x").alias("node"), F.least("x", "_m").alias("root")), "roots")
    while True:
        of_y = labels.select(F.col("node").alias("y"), F.col("root").alias("_r"))
        near = edges.join(of_y, "y").groupBy("x").agg(F.min("_r").alias("_m"))
        met = labels.join(near, labels["node"] == near["x"]).select("node", "root", F.least("root", "_m").alias("new"))
        calls = met.select(F.explode(F.array(F.struct("node", F.col("new").alias("root")), F.struct(F.col("root").alias("node"), F.col("new").alias("root")))).alias("_c"))
        hooked = keep(calls.groupBy("_c.node").agg(F.min("_c.root").alias("root")), "hooks")
        of_root = hooked.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        after = keep(hooked.join(of_root, "root").select("node", F.least("root", "_r").alias("root")), "roots")
        moved = after.withColumnRenamed("root", "_now").join(labels, "node").where("_now <> root")
        labels = after
        if moved.isEmpty():
            return labels.select("node", F.col("root").alias("component"))
