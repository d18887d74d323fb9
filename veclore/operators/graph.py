"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclore.runtime import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Large star and small star in turn: every node hooks its larger neighbours, then itself and its smaller neighbours, to
    the smallest node it sees, until only stars are left. Rounds grow with the logarithm of the nodes, for chains in any
    order too, and there is no limit to them. Edges are written tables: nothing is held by the driver, and a lost executor
    recomputes one round at most. Minima are combined before each shuffle, so a hub costs one row per partition. Defined
    cases: loops, repeated and reversed edges are harmless; edges with a NULL end are ignored; an empty table gives an
    empty result.
    """
    given = written(edges.where("a is not null and b is not null").select("a", "b").distinct(), "edges")
    nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    # from here on b is the smaller end
    held = written(given.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(held):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        hooked = large.join(least, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        held = written(hooked.unionByName(least.withColumnRenamed("low", "b")).distinct(), "edges")
    return nodes.join(held.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def _stars(held: DataFrame) -> bool:
    """No node has two smaller ones, and none that has a smaller one is the smaller one of another."""
    if not held.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return held.join(held.select(F.col("b").alias("other")), F.col("a") == F.col("other"), "left_semi").isEmpty()
