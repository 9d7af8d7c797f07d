"""SQL databases over JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Driver classes by database.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
# End of fixed values.


def jdbc_options(
    url: str,
    final_query: str,
    preparatory_queries: Sequence[str] = (),
    timeout: int = 0,
    partition: Mapping[str, str | int] | None = None,
    database: str | None = None,
    properties: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. Preparatory statements run on every connection that reads.

    `partition` = {column, lower, upper, parts} reads in parallel ranges; without
    it one task reads everything, so give it for large results.
    """
    options = {"url": url, "queryTimeout": str(timeout), "fetchsize": str(fetch_size)}
    if database is not None:
        options["driver"] = DRIVERS[database]
    if preparatory_queries:
        options["sessionInitStatement"] = "; ".join(q.rstrip().rstrip(";") for q in preparatory_queries)
    query = final_query.rstrip().rstrip(";")
    if partition is None:
        options["query"] = query
    else:
        options["dbtable"] = f"({query}) final_query"
        options["partitionColumn"] = str(partition["column"])
        options["lowerBound"] = str(partition["lower"])
        options["upperBound"] = str(partition["upper"])
        options["numPartitions"] = str(partition["parts"])
    options.update(properties or {})
    return options


def read_sql(spark: SparkSession, url: str, final_query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, final_query, **options)).load()
