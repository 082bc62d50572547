"""Connected components by least labels and pointer jumping, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the least node that is reachable.

    Each round takes the least label among neighbours and then the label of the
    label, so rounds grow with the logarithm of a path's length. Every join is a
    plain equi-join of exchanged sides and every aggregate combines before its
    exchange, so a hub with a third of all edges is split by adaptive execution.
    Self-loops and repeated edges change nothing; no edges give no rows.
    """
    pairs = edges.select("a", "b").where("a <> b").distinct()
    both = materialize(pairs.union(pairs.select("b", "a")).toDF("a", "b"), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = materialize(lower.join(jump, "low").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels.lexaudit_path = new.lexaudit_path
        if not moved:
            discard(both)
            return labels
