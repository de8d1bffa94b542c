"""Connected components by contraction.

Each round gives every node the smallest node among itself and its neighbours, then replaces nodes by the
ends of those pointers; what is left is a graph of at most half as many nodes. The pointers of all rounds
are joined back in reverse. Every step is a join or a combined aggregate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.sources.shared import settled


def flattened(pointers: DataFrame) -> DataFrame:
    """Pointers (node, to) of a forest with each node pointing at its root."""
    while True:
        up = pointers.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        jumped = settled(pointers.join(up, "to", "left").select("node", "to", F.coalesce("_next", "to").alias("_next")))
        if not jumped.where("_next <> to").take(1):
            return jumped.select("node", "to")
        pointers = jumped.select("node", F.col("_next").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (a, b) the smallest node that it reaches: node, component."""
    rounds = []
    edges = settled(edges.select("a", "b").where("a <> b").distinct())
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least")).select("node", F.least("node", "_least").alias("to"))
        rounds.append(flattened(smallest))
        ends = rounds[-1]
        left = edges.join(ends.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a")
        both_ends = left.join(ends.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        edges = settled(both_ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("_end"))
        found = earlier.join(later, "to", "left").select("node", F.coalesce("_end", "to").alias("to"))
    return settled(found.select("node", F.col("to").alias("component")))
