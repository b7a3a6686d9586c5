"""Connected components as Spark joins: least neighbours and pointer jumping, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of any orderable type. Rows: (node, root), root the least node reachable; every node of an edge once."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        best = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("new"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("above"))
        # A node takes the root of the label it found: the way to the least node halves each round.
        moved = written(best.join(up, best.new == up.up, "left").select("node", "root", F.least("new", F.coalesce("above", "new")).alias("new")))
        changed = moved.where("new < root").limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found, the (node, root) of older links, with new links (a, b): only the roots that they join are looked at again."""
    links = written(links.select("a", "b"))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    nodes = found.unionByName(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
    of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    roots = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(roots.where("a != b")).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return written(nodes.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
