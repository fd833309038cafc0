"""Connected components of an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for each node of an edge.

    In a round each node points to the smallest of itself and its neighbours, pointers are
    followed to their ends, and the edges that join different ends are the next round's.  A
    round leaves at most half of the nodes that still have an edge, and a star is done after two.  Messages to a node are
    combined before the shuffle.  Tables are written to the shared folder, so that the plan
    stays short and a lost executor costs one step.
    """
    edge = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, label = stored(edge, "edges"), None
    while True:
        ends = _ends(left)
        label = ends if label is None else label.join(ends.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = stored(label, "label")
        a, b = ends.toDF("a", "x"), ends.toDF("b", "y")
        between = left.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        left = stored(between, "edges")
        if left.isEmpty():
            return label


def _ends(edge: DataFrame) -> DataFrame:
    """(node, component): where the pointers to smallest neighbours lead."""
    both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "pointers")
    while True:
        one = up.join(up.toDF("component", "one"), "component").select("node", "one")
        two = one.join(up.toDF("one", "component"), "one").select("node", "component", F.col("one"))
        up = stored(two, "pointers")
        if up.where("component <> one").isEmpty():
            return up.select("node", "component")
        up = up.select("node", "component")
