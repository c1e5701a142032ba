"""Connected components by alternating large-star and small-star steps, all in joins and aggregates.

Minima per node are combined before the shuffle and joined back to the edges, so a node with very many
edges is never gathered; a hot node only makes a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) to edges towards each node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    met = both.join(low, F.col("u") == F.col("n"))
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` has longs a, b. Returns (node, root) for every node but roots: root is its smallest node."""
    now = Staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = Staged(_star(_star(now.read(), large=True), large=False), "edges")
        now.drop()
        now = new
        seen = now.read().agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            return now.read().select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
