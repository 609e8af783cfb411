"""Connected components of an edge table, by large and small stars.

Every round is two aggregates and two joins over the edges, written to the shared
folder; neither edges nor components ever reach the driver, only a count and a
checksum that tell whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    joined = both.join(least, both["u"] == least["node"]).filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    joined = edges.join(least, edges["u"] == least["node"])
    ties = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.union(least.select(F.col("node").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; edges are (u, v) of longs.

    The component is its smallest node. Loops and repeated edges do no harm.
    """
    given = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialise(given.distinct(), "edges")
    last = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == last:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = mark
        current = materialise(_small_star(_large_star(current).distinct()).distinct(), "edges")
