"""Connected components of an undirected graph by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, staged_so_far


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of edges (a, b) reaches.

    A round gives each node the least label among itself and its neighbours,
    then the label of that label: labels settle in about the logarithm of the
    diameter. Minima are combined before the shuffle, so a node with many links
    is no larger a group than others. Null ends are ignored; an empty table has
    no nodes.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        mark = staged_so_far()
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        closer = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        closer = staged(closer, "closer")
        jump = closer.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = closer.join(jump, "to", "left").select("node", F.least("to", "further").alias("label"), "old")
        new = staged(new, "labels")
        discard(edges.sparkSession, mark, new)
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
