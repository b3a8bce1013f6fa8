"""Connected components of an edge table, by random-priority contraction.

Each round every node points at the neighbour (or itself) of the smallest hashed priority,
edges are relabelled by what their ends point at, and loops and repeats go. The number of
nodes falls by a constant factor a round whatever the order of ids. Nothing is collected;
minima are combined before the shuffle, and joins read written tables, so that adaptive
execution can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. One row per node that has an edge: id, component (the smallest id reachable)."""
    edge = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parents: list[DataFrame] = []
    while not edge.isEmpty():
        turn = len(parents)
        both = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edge.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v")).alias("m"))
        to = F.when(F.col("m.h") < F.xxhash64("u", F.lit(turn)), F.col("m.v")).otherwise(F.col("u"))
        parents.append(written(best.select(F.col("u").alias("id"), to.alias("to"))))
        left, right = (parents[-1].select(F.col("id").alias(c), F.col("to").alias("to_" + c)) for c in "ab")
        moved = edge.join(left, "a").join(right, "b").filter("to_a <> to_b")
        edge = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not parents:
        return edge.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = parents[0].withColumnRenamed("to", "root")
    for step in parents[1:]:
        root = root.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    root = written(root)
    return root.join(root.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
