"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmill.llm.shared import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: (node, component), for nodes with an edge to another.

    Edges are columns a and b of one integer type; nulls are passed over, repeats and
    loops do no harm. Each round gives every node its smallest neighbour as parent and
    contracts the graph. Nothing is gathered on the
    driver; a star of any size costs one row an edge. Parents are followed to their
    ends by doubling, so a chain of n nodes takes about log n joins.
    """
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "parents")
        while True:
            above = parent.toDF("parent", "root")
            further = parent.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved"))
            further = materialize(further, "parents")
            moved = not further.where("moved").isEmpty()
            drop(parent)
            parent = further.drop("moved")
            if not moved:
                break
        last = labels
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        of_a, of_b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        nxt = edges.join(of_a, "a").join(of_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        nxt = materialize(nxt, "edges")
        drop(edges)
        if last is not None:
            drop(parent)
        edges = nxt
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    return labels
