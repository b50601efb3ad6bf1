"""Connected components of an edge table, by labels that jump: rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.storage import written


def meeting(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: a table that grows with the input is never collected for a broadcast, however small it is now."""
    return df.hint("merge")


def connected_components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, node, component) for every node of edges (*keys, a, b): the least node that its own reaches, within equal keys.

    A round hands each node the least label among its neighbours, then the label of its label.  What a round made is a
    written table, which the next one reads; it ends when a round changes nothing."""
    k = list(keys)
    both = edges.select(*k, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(*k, F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(*k, "node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(meeting(labels.select(*k, F.col("node").alias("other"), "component")), [*k, "other"]).groupBy(*k, "node").agg(F.min("component").alias("near"))
        pulled = labels.join(meeting(near), [*k, "node"]).select(*k, "node", F.least("component", "near").alias("label"), F.col("component").alias("before"))
        ahead = labels.select(*k, F.col("node").alias("label"), F.col("component").alias("jumped"))
        moved = pulled.join(meeting(ahead), [*k, "label"]).select(*k, "node", F.least("label", "jumped").alias("component"), "before")
        moved = written(moved, "labels")
        labels = moved.drop("before")
        if moved.filter("component <> before").isEmpty():
            return labels
