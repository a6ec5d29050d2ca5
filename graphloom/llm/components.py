"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that links reach, for each node of ``links``.

    Each round points every node at its smallest neighbour, follows the pointers once more, and
    relabels the links; a chain shrinks to a fraction of its length in each round.  Every round
    ends in a written table.  Minima are taken per task before a shuffle, so a hub is no hot key.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = materialize(both.distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        ways = edges.union(edges.select("b", "a"))
        point = ways.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
        point = materialize(point, "pointers")
        on = point.select(F.col("a").alias("to"), F.col("to").alias("next"))
        point = point.join(on, "to").select("a", F.col("next").alias("to"))
        point = materialize(point, "pointers")
        of = {c: point.select(F.col("a").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")}
        edges = edges.join(of["a"], "a").join(of["b"], "b").select(
            F.col("a2").alias("a"), F.col("b2").alias("b")
        )
        edges = materialize(edges.filter("a <> b").distinct(), "links")
        labels = labels.join(
            point.select(F.col("a").alias("component"), "to"), "component", "left"
        ).select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
    return labels
