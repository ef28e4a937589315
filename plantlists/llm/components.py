"""Connected components of an edge table by repeated minimum labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the least node that can be reached.

    Each round maps edges to the labels at their ends, points every label to the least label next to it, follows these pointers
    to their roots (each pointer leads to a smaller label, so they have roots) and relabels. Edges inside one label leave, so later
    rounds work on what is still apart. Nulls and loops are left out; an empty table gives an empty table.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges")
    labels = staged(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        between = edges.join(left, "a").join(right, "b").where("ca <> cb")
        between = staged(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "between")
        if between.isEmpty():
            return labels
        both = between.union(between.select("b", "a"))
        point = staged(both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("low")).select("label", F.least("label", "low").alias("to")), "pointers")
        for _ in range(MAX_ROUNDS):
            ahead = point.select(F.col("label").alias("to"), F.col("to").alias("further"))
            further = staged(point.join(ahead, "to").select("label", F.col("further").alias("to"), (F.col("further") < F.col("to")).alias("moved")), "pointers")
            point = further.select("label", "to")
            if further.where("moved").isEmpty():
                break
        labels = labels.join(point, labels.component == point.label, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = staged(labels, "labels")
        edges = between  # a label is the least node that carries it, so it is found in labels as a node
    raise RuntimeError(f"components still apart after {MAX_ROUNDS} rounds")
