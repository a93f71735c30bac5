"""Connected components by hooking and pointer jumping.

Every round hooks each component onto its smallest neighbour (an aggregate with
partial minima), shortens the chains this makes by joining parents with their
parents, and contracts the edges.  Only edges and parents move.  What is joined
has been written to the shared folder first, so a hub is an ordinary hot key
that the skew join splits, and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import materialise


def _parents(edges: DataFrame) -> DataFrame:
    """(node, parent): the smallest neighbour of each node that has a smaller one, followed to the end."""
    up = materialise(edges.groupBy("b").agg(F.min("a").alias("parent")).withColumnRenamed("b", "node"))
    while True:
        further = up.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        if up.join(further, "parent", "left_semi").isEmpty():
            return up
        up = materialise(up.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``; component is the smallest node reachable.

    Self-loops, repeated edges and either direction are allowed; rows with a
    null end are ignored.  Nodes without edges do not appear; no edges, no rows.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = materialise(ordered(edges.select("a", "b")))
    label = None
    while not left.isEmpty():
        up = _parents(left)
        root = lambda df, c: df.join(up.select(F.col("node").alias(c), "parent"), c, "left").withColumn(c, F.coalesce("parent", c)).drop("parent")  # noqa: B023, E731
        left = materialise(ordered(root(root(left, "a"), "b")))
        if label is None:
            label = up.withColumnRenamed("parent", "component")
        else:
            again = up.select(F.col("node").alias("component"), "parent")
            label = label.join(again, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            label = materialise(label.unionByName(up.withColumnRenamed("parent", "component")).groupBy("node").agg(F.min("component").alias("component")))
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
