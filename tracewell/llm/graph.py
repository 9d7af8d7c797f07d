"""Distributed union-find: connected components by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) -> (node, root) with the smallest node of each component; roots have no row.

    Every step hooks nodes to the smallest neighbour by a partial minimum and a join, and writes the new edges; nothing
    gathers a node's neighbours. Rounds grow with the logarithm of the number of nodes.
    """
    now = saved(_clean(edges.select("a", "b")), "edges")
    last = None
    while True:
        print_of = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if print_of == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = print_of
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "of")
        large = both.join(least, F.col("a") == F.col("of")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _clean(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = large.join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(_clean(small.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))), "edges")


def _clean(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops, each edge once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
