"""Inputs derived from the given tables, and the same derivations as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tables_in(spark: SparkSession, folder: str, text: str) -> dict[str, DataFrame]:
    words = set(re.findall(r"\w+", text))
    return {n: table(spark, folder, n) for n in TABLES if n in words}


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as alerts with flat dotted names, missing hosts and list cells."""
    return table(spark, folder, "events").selectExpr(
        "ts AS `@timestamp`",
        "event_id AS `process.pid`",
        "CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('host-', user_id) END AS `host.hostname`",
        "event_type AS `rule.name`",
        "CASE WHEN event_id % 2 = 0 THEN array(event_type) ELSE array(event_type, 'audit') END AS `rule.indices`",
        "concat('cmd-', CAST(floor(value / 50) AS BIGINT)) AS `process.command_line`",
        "value",
    )


ALERTS = """
alerts AS (
  SELECT ts, event_id AS pid, CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('host-', user_id) END AS host,
         event_type AS rule,
         CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat(event_type, ',audit') END AS indices,
         concat('cmd-', CAST(floor(value / 50) AS BIGINT)) AS command, value
  FROM events)
"""


def processes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as process starts: every process has two children or fewer."""
    return table(spark, folder, "events").selectExpr(
        "event_id AS `_id`", "event_id AS `process.pid`", "event_id div 2 AS `process.parent.pid`", "ts AS `@timestamp`"
    )


PROCESSES = "processes AS (SELECT event_id AS id, event_id AS pid, event_id // 2 AS parent, ts FROM events)"

_ADDRESS = """
CASE c_custkey % 50 WHEN 0 THEN 'not-an-ip'
  WHEN 1 THEN concat('fd00::', {hex})
  WHEN 2 THEN concat('2a00:1450::', {hex})
  WHEN 3 THEN concat('256.1.2.', c_custkey % 256)
  WHEN 4 THEN concat('8.8.', c_custkey {div} 256 % 256, '.', c_custkey % 256)
  ELSE concat('10.', n_regionkey, '.', n_nationkey, '.', c_custkey % 256) END"""


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """An address per customer: private, public, IPv6 and malformed ones."""
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey", "c_name", "c_acctbal", "n_regionkey", "n_nationkey",
        _ADDRESS.format(hex="lower(hex(c_custkey % 65536))", div="div") + " AS address",
    )


ADDRESSES = (
    "addresses AS (SELECT c_custkey, c_name, c_acctbal, n_regionkey, n_nationkey, "
    + _ADDRESS.format(hex="format('{:x}', c_custkey % 65536)", div="//")
    + " AS address FROM customer JOIN nation ON c_nationkey = n_nationkey)"
)


def prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Nested networks: one for all, per region, per nation, and single hosts in debt."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    world = spark.range(1).selectExpr("'10.0.0.0/8' AS prefix", "'' AS description", "0 AS depth")
    local = spark.range(1).selectExpr("'fd00::/8' AS prefix", "'unique local' AS description", "0 AS depth")
    regions = nations.selectExpr("concat('10.', r_regionkey, '.0.0/16') AS prefix", "r_name AS description", "1 AS depth")
    places = nations.selectExpr(
        "concat('10.', r_regionkey, '.', n_nationkey, '.0/24') AS prefix", "n_name AS description", "2 AS depth"
    )
    hosts = (
        addresses(spark, folder)
        .where("c_acctbal < 0 AND c_custkey % 50 > 4")
        .selectExpr("concat(address, '/32') AS prefix", "'in debt' AS description", "3 AS depth")
    )
    return world.union(local).union(regions.distinct()).union(places).union(hosts.distinct())


PREFIXES = """
nested AS (
  SELECT '10.0.0.0/8' AS prefix, '' AS description, 0 AS depth
  UNION ALL SELECT DISTINCT concat('10.', r_regionkey, '.0.0/16'), r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('10.', n_regionkey, '.', n_nationkey, '.0/24'), n_name, 2 FROM nation
  UNION ALL SELECT DISTINCT concat(address, '/32'), 'in debt', 3 FROM addresses WHERE c_acctbal < 0 AND c_custkey % 50 > 4),
-- An address of the 10/8 world is in a network when it starts with the network's fixed octets.
holding AS (
  SELECT a.address, p.* FROM (SELECT DISTINCT address FROM addresses WHERE address LIKE '10.%') a JOIN nested p
  ON CASE p.depth WHEN 0 THEN true
     WHEN 1 THEN starts_with(a.address, replace(p.prefix, '0.0/16', ''))
     WHEN 2 THEN starts_with(a.address, replace(p.prefix, '.0/24', '.'))
     ELSE a.address = replace(p.prefix, '/32', '') END
  UNION ALL
  SELECT DISTINCT address, 'fd00::/8', 'unique local', 0 FROM addresses WHERE address LIKE 'fd00::%')
"""
