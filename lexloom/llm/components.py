"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._shared import durable


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached from node. links(a, b) are undirected; loops and repeats are fine.

    Each round points every node at its smallest neighbour (or itself), follows the pointers twice, and
    contracts the links to those between the nodes arrived at; the links shrink by half at least, so the
    rounds are logarithmic in the longest chain. Tables between rounds are written to the shared folder.
    """
    links = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        for _ in range(2):
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = step.join(far, "to").select("node", F.col("far").alias("to"))
        step = durable(step, "pointers")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            onward = step.select(F.col("node").alias("component"), "to")
            labels = durable(labels.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = durable(moved, "links")
        if links.isEmpty():
            return labels
