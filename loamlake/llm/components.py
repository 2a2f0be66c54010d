"""Connected components by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.runtime import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    In each step a node takes the least label among its neighbours, and then the
    label which that label's node had: chains shorten by half, stars end at once. A node with
    very many edges is met by the join's skew split and by partial minima. Every step
    writes one row per node to the shared folder; the steps end when no label changes.
    """
    ends = edges.select("a", "b").filter("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    pairs = cut_lineage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), "component")
        near = pairs.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        further = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        moved = hooked.join(further, "to", "left").select("node", "old", F.least("to", "beyond").alias("component"))
        step = cut_lineage(moved.select("node", "component", (F.col("component") != F.col("old")).alias("changed")), "labels")
        labels = step.drop("changed")
        if step.filter("changed").isEmpty():
            return labels
