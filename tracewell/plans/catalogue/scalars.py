"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.network import ip_is_private, ip_port2ip, validate_ip_address
from tracewell.functions.text import bytes_to_string, regexp_find_all, regexp_search, regexp_substr
from tracewell.functions.times import (
    datetime_to_timestamp, local_to_epoch_millis, shift_seconds, unixtime_to_iso_timestamp,
)
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import ADDRESSES, addresses, table

R = Registry()


@R.query("f_regexp", "SELECT doc_id, regexp_matches(text, '\\b[Tt]he\\b') AS found FROM documents")
def f_regexp(spark, folder):
    return table(spark, folder, "documents").select("doc_id", regexp_search(r"\b[Tt]he\b", "text").alias("found"))


@R.query(
    "f_regexp_all",
    """SELECT page_id, concat('[', array_to_string(list_transform(regexp_extract_all(html, 'href="(/[^"]*)"', 1), lambda x: concat('''', x, '''')), ', '), ']') AS links,
              len(regexp_extract_all(html, '[a-z]+\\.html')) AS files FROM pages""",
)
def f_regexp_all(spark, folder):
    """All link targets of a page as list text, and a count of the array form."""
    return table(spark, folder, "pages").select(
        "page_id",
        regexp_substr(r'href="(/[^"]*)"', "html").alias("links"),
        F.size(regexp_find_all(r"[a-z]+\.html", "html")).cast("bigint").alias("files"),
    )


@R.query(
    "f_ip_private",
    f"WITH {ADDRESSES} SELECT c_custkey, address LIKE '10.%' OR address LIKE 'fd00::%' AS private FROM addresses",
)
def f_ip_private(spark, folder):
    return addresses(spark, folder).select("c_custkey", ip_is_private("address").alias("private"))


@R.query(
    "f_ip_valid",
    f"WITH {ADDRESSES} SELECT c_custkey, address, address <> 'not-an-ip' AND NOT starts_with(address, '256.') AS valid FROM addresses",
)
def f_ip_valid(spark, folder):
    return addresses(spark, folder).select("c_custkey", "address", validate_ip_address("address").alias("valid"))


@R.query(
    "f_unix_iso",
    """SELECT event_id, concat(strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g'), '+00:00') AS at,
              concat('-', event_id) AS kept FROM events""",
)
def f_unix_iso(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "event_id",
        "format_string('%d.%06d', unix_micros(cast(ts AS timestamp)) div 1000000, unix_micros(cast(ts AS timestamp)) % 1000000) AS x",
        "concat('-', event_id) AS negative",
    )
    return events.select(
        "event_id", unixtime_to_iso_timestamp("x").alias("at"), unixtime_to_iso_timestamp("negative").alias("kept")
    )


@R.query(
    "f_bytes",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * l_quantity * 1000 AS BIGINT) AS n FROM lineitem)
       SELECT l_orderkey, l_linenumber, n, CASE WHEN n = 0 THEN '0B' WHEN n >= 1073741824 THEN concat(round_even(n / 1073741824, 2), ' GB')
         WHEN n >= 1048576 THEN concat(round_even(n / 1048576, 2), ' MB') WHEN n >= 1024 THEN concat(round_even(n / 1024, 2), ' KB')
         ELSE concat(n, '.0 B') END AS size FROM s""",
)
def f_bytes(spark, folder):
    sizes = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(round(l_extendedprice * l_quantity * 1000) AS BIGINT) AS n"
    )
    return sizes.select("l_orderkey", "l_linenumber", "n", bytes_to_string("n").alias("size"))


@R.query(
    "f_ip_port",
    f"""WITH {ADDRESSES}, p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(address, ':443') ELSE address END AS endpoint FROM addresses)
    SELECT c_custkey, split_part(endpoint, ':', 1) AS ip,
           CASE WHEN contains(endpoint, ':') THEN split_part(endpoint, ':', 1) ELSE left(endpoint, length(endpoint) - 1) END AS ip_compat FROM p""",
)
def f_ip_port(spark, folder):
    endpoints = addresses(spark, folder).selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN concat(address, ':443') ELSE address END AS endpoint"
    )
    return endpoints.select(
        "c_custkey", ip_port2ip("endpoint").alias("ip"), ip_port2ip("endpoint", compat=True).alias("ip_compat")
    )


@R.query(
    "f_dt_epoch",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE epoch_us(ts) / 1000000 - 10800 END AS at FROM events",
)
def f_dt_epoch(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 4 = 0 THEN 'no time' ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+0300') END AS text",
    )
    return events.select("event_id", datetime_to_timestamp("text", "%Y-%m-%dT%H:%M:%S.%f%z").alias("at"))


@R.query(
    "ts_shift",
    """SELECT event_id, strftime(ts - INTERVAL 600 SECOND, '%Y-%m-%dT%H:%M:%S') AS start, strftime(ts + to_seconds(user_id), '%d.%m.%Y %H:%M:%S') AS stop,
              epoch_us(ts) // 1000000 * 1000 - 10800000 AS millis FROM events""",
)
def ts_shift(spark, folder):
    """Bounds around a text time, and a Moscow wall-clock time as epoch milliseconds."""
    events = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS text", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS wall"
    )
    full = "%Y-%m-%dT%H:%M:%S.%f"
    return events.select(
        "event_id",
        shift_seconds(F.col("text"), -600, full, "%Y-%m-%dT%H:%M:%S").alias("start"),
        shift_seconds(F.col("text"), F.col("user_id"), full, "%d.%m.%Y %H:%M:%S").alias("stop"),
        local_to_epoch_millis(F.col("wall"), "Europe/Moscow", "%Y-%m-%d %H:%M:%S").alias("millis"),
    )
