"""Connected components of an edge table, by alternating large and small stars.

Each round links the neighbours of a node to the smallest node near it, once for its larger and
once for its smaller neighbours, until only stars are left. Rounds grow with the logarithm of
the size of components. Minima are combined before they are shuffled; the join that brings them
back to the edges of a node with very many has an exchange on either side, so Spark splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, of all nodes that ``edges(a, b)`` link.

    Edges have no direction; those with a null end, and from a node to itself, link nothing.
    Nodes without other edges are not returned.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = _small_star(_large_star(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least")), "star-roots")
    linked = both.filter("b > a").join(least, F.col("a") == F.col("_a"))
    return settle(linked.select(F.col("b").alias("a"), F.least("_a", "_least").alias("b")).distinct(), "large-stars")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = settle(edges.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least")), "star-roots")
    linked = edges.join(least, F.col("a") == F.col("_a"))
    moved = linked.filter("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return settle(moved.unionByName(least.select(F.col("_a").alias("a"), F.col("_least").alias("b"))).distinct(), "small-stars")
