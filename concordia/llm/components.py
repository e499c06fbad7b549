"""Connected components of a link table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import drop_table, written


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of a link table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links`` but the roots; a root is its component's least id.

    Each round hangs every neighbour under the least id seen, first among larger neighbours,
    then among smaller ones; the rounds needed grow with the logarithm of the longest chain.
    Only minima per node are gathered, never a node's neighbours.  The minima are written before
    they are joined back, so both sides of that join are plain shuffles and the partition of a hub
    with a third of all links can be split.  Every round is a table in the shared folder.
    """
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.union(low).distinct(), "links")
        was, mark = mark, _mark(after)
        for t in (edges, least, large, low):
            drop_table(t)
        edges = after
        if mark == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
