"""Connected components of a graph that is held in tables only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm._shared import cut, discard


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``m``, the least neighbour of their node u, and the table behind it).

    The least neighbours are map-side combined and written down, so that the join reads both sides as plain exchanges: a hub's edges are
    then dealt to several tasks by Spark's handling of skewed joins.
    """
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u"), least


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node that it reaches.

    Alternates the large-star and small-star steps until the edges are stars around the least nodes, however many rounds that takes
    (about the square of the logarithm of their number at most). Each round is written to the shared checkpoint folder and the round
    before it deleted, so that a lost executor repeats one round at most. Nothing but one row of totals a round reaches the driver.
    Rows with a null end or a self loop add no node; no edges give no rows. Nodes are of any type that has an order.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every greater neighbour is linked with the least of all neighbours and the node itself
        met, low = _with_least(both)
        large = cut(met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # small star: every smaller neighbour, and the node itself, is linked with the least of them
        met, least = _with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(small)
        discard(old, low, large, least)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
