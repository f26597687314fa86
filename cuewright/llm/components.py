"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node of (a, b) edges.

    Each round gives a node the smallest label among its neighbours', and then
    that label's own label, until nothing changes. Labels are written after each
    round. No edges give no rows.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumps = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = durable(moved.join(jumps, "root").select("node", "old", F.least("root", "further").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root != old").isEmpty():
            return labels
