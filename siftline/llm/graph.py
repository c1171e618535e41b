"""Connected components of an edge table, without holding a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of `edges` (a, b): label is the least node it is connected with.

    Labels spread along edges and then jump to their label's label, so that a chain of n
    nodes takes about log n rounds. Every round joins written tables only, so a node with any
    share of the edges can be split, and minima are combined before they are shuffled. A round
    ends in a written table: a lost executor costs at most that round.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("heard")
        )
        lower = materialize(
            labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "labels"
        )
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = materialize(
            lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels"
        )
        if labels.where("old <> label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
