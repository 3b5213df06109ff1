"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of some edge can reach.

    Every node points to its smallest neighbour, pointers are followed to their roots,
    and edges between roots go into the next round.  Each round is a written table.
    """
    edges = materialize(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    while not edges.isEmpty():
        pointers = materialize(edges.groupBy("b").agg(F.min("a").alias("a")), "component-pointers")
        while True:
            ahead = pointers.select(F.col("b").alias("a"), F.col("a").alias("next"))
            moved = pointers.join(ahead, "a", "left")
            pointers = materialize(moved.select("b", F.coalesce("next", "a").alias("a"),
                                                F.col("next").isNotNull().alias("moved")), "component-pointers")
            still = not pointers.filter("moved").isEmpty()
            pointers = pointers.drop("moved")
            if not still:
                break
        to = lambda name: pointers.select(F.col("b").alias(name), F.col("a").alias(f"{name}_root"))
        labels = materialize(labels.join(to("label"), "label", "left").select(
            "node", F.coalesce("label_root", "label").alias("label")), "component-labels")
        rooted = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
        edges = materialize(rooted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                            "component-edges")
    return labels
