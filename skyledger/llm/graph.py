"""Connected components by contraction, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")


def _shorten(parents: DataFrame) -> DataFrame:
    """Replace each parent by its own parent, two steps up."""
    up = parents.select(F.col("node").alias("via"), F.col("parent").alias("top"))
    once = parents.join(up, parents.parent == up.via, "left").select("node", F.coalesce("top", "parent").alias("parent"))
    return once.join(up, once.parent == up.via, "left").select("node", F.coalesce("top", "parent").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is named by its least node.

    Each round points every node at its least neighbour, follows the pointers and contracts the graph to the
    nodes pointed at, until no edge between different nodes is left. Every round is stored in the shared folder;
    the driver sees only whether edges remain.
    """
    live = materialize(_both(edges).distinct(), "edges")
    labels = None
    while True:
        parents = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent"))
        parents = materialize(_shorten(materialize(parents, "parents")), "parents")
        step = parents.select(F.col("node").alias("was"), F.col("parent").alias("now"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            labels = materialize(labels.join(step, labels.component == step.was, "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
        left = live.join(step, live.a == step.was).select(F.col("now").alias("a"), "b")
        left = left.join(step, left.b == step.was).select("a", F.col("now").alias("b"))
        live = materialize(left.filter("a <> b").distinct(), "edges")
        if live.isEmpty():
            return labels
