"""Connected components of any size, in rounds that grow with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import write_and_read

# Rows that meet at one node by the end of a component's rounds, and are then told by broadcast.
HOT_LINKS = 100_000


def _told(rows: DataFrame, key: str, facts: DataFrame, result: list[Column], hot_links: int) -> DataFrame:
    """`result` of every row and the fact of the node it names in `key`; nodes of over `hot_links` rows, few of all rows, are not dealt by key."""
    hot = rows.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_links).select("of")
    few = facts.join(F.broadcast(hot), "of", "left_semi")
    here = F.col(key) == F.col("of")
    usual = rows.join(F.broadcast(hot), here, "left_anti").join(facts, here).select(*result)
    return usual.unionByName(rows.join(F.broadcast(few), here).select(*result))


def connected(links: DataFrame, hot_links: int = HOT_LINKS) -> DataFrame:
    """`links` (a, b), numbers in any order and repetition -> (node, root) with the least node of each component.

    A root names itself; nodes whose links are all loops are components of their own; rows with a null are no links.
    A round first hangs every node on the least node next to it (neighbours above it are handed to that one), then every
    node on the least of those it hangs on, until nothing moves. Least nodes are partial minima and neighbours are
    never gathered, nor dealt to one task, so a node may have any number of them.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down"))
    # Loops stay in the table, so that every node keeps a row.
    now, sign = write_and_read(links.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.col("down").cast("decimal(38,0)")).alias("s"), F.sum((F.xxhash64("up", "down") % 1_000_003)).alias("h")).first()
        if state == sign:
            break
        sign = state
        sides = now.selectExpr("up AS of", "down AS least").unionByName(now.selectExpr("down AS of", "up AS least"))
        least = sides.groupBy("of").agg(F.least("of", F.min("least")).alias("least"))
        # Neighbours above a node go to its least one; a node's own row keeps it known.
        above = _told(now, "down", least, [F.col("up"), F.col("least").alias("down")], hot_links)
        own = least.selectExpr("of AS up", "least AS down")
        large = above.unionByName(own).distinct()
        lower = large.groupBy(F.col("up").alias("of")).agg(F.min("down").alias("least"))
        small = _told(large, "up", lower, [F.col("down").alias("up"), F.col("least").alias("down")], hot_links)
        now = write_and_read(small.unionByName(lower.selectExpr("of AS up", "least AS down")).distinct(), "links")
    return now.groupBy(F.col("up").alias("node")).agg(F.min("down").alias("root"))
