"""SQL steps, chains of steps, parameters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.aggregate import aggregate_by_time
from tracewell.operators.apply import Bind, apply_within, bind_parameters
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import ADDRESSES, addresses, table
from tracewell.plans.steps import Step, nested_chain, run_chain, run_chain_reused, sql_step
from tracewell.session import new_path
from tracewell.streaming.events import alert_once, bucket_stream, latest_buckets, read_events, run_alert, run_append, run_updates

R = Registry()


@R.query(
    "sql_step",
    f"""WITH {ADDRESSES}
    SELECT n_nationkey AS nation, count(*) AS hosts, count(*) FILTER (WHERE address LIKE '10.%' OR address LIKE 'fd00::%') AS private,
           count(*) FILTER (WHERE address = 'not-an-ip' OR address LIKE '256.%') AS bad FROM addresses GROUP BY n_nationkey""",
)
def step(spark, folder):
    """Preparatory SELECTs with the registered functions, then the final one."""
    return sql_step(
        spark,
        {"found": addresses(spark, folder)},
        """SELECT nation, count(*) AS hosts, count_if(ip_is_private(ip)) AS private, count_if(NOT validate_ip_address(ip)) AS bad
           FROM cleaned GROUP BY nation""",
        preparatory_queries=[
            ("endpoints", "SELECT n_nationkey AS nation, concat(address, CASE WHEN address LIKE '%:%' THEN '' ELSE ':80' END) AS endpoint FROM found"),
            ("cleaned", "SELECT nation, CASE WHEN endpoint LIKE '%::%' THEN endpoint ELSE ip_port2ip(endpoint) END AS ip FROM endpoints"),
        ],
    )


@R.query(
    "sql_functions",
    """SELECT doc_id, regexp_matches(text, '[0-9]{3,}') AS found,
              concat('[', array_to_string(list_transform(regexp_extract_all(text, '[0-9]{3,}'), lambda x: concat('''', x, '''')), ', '), ']') AS numbers
       FROM documents""",
)
def pattern_functions(spark, folder):
    """The pattern-first functions by their established names."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = "SELECT doc_id, regexp('[0-9]{3,}', text) AS found, regexp_substr('[0-9]{3,}', text) AS numbers FROM docs"
    return sql_step(spark, {"docs": docs}, text)


def chain(spark, folder, least: float):
    """Large errors, what their users did just before, and hourly counts of that."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    binds = [Bind("user_id", "user"), Bind("ts", "at"), Bind("event_id", "id")]
    steps = [
        Step("large", lambda r: r["events"].where((F.col("event_type") == "error") & (F.col("value") >= least)), show=False),
        Step("before", lambda r: apply_within(
            bind_parameters(r["large"], binds), r["events"], {"applied_user": "user_id"}, "applied_at", "ts", 7200, 0)),
        Step("hours", lambda r: aggregate_by_time(
            r["before"].withColumnRenamed("ts", "hour"), ["event_type"], {"event_id": ["count"]}, "hour", "1h")),
    ]
    return run_chain(steps, {"events": events})


CHAIN = """WITH large AS (SELECT * FROM events WHERE event_type = 'error' AND value >= {least}),
     seen AS (SELECT e.event_id, e.event_type, e.ts FROM large a JOIN events e
                ON e.user_id = a.user_id AND e.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts)
     SELECT event_type, date_trunc('hour', ts) AS hour, count(event_id) AS event_id_count FROM seen GROUP BY ALL"""


@R.query("step_chain", CHAIN.format(least=50))
def step_chain(spark, folder):
    return chain(spark, folder, 50.0)["hours"]


@R.query("chain_nested", CHAIN.format(least=20))
def chain_nested(spark, folder):
    return nested_chain(chain, "hours", spark=spark, folder=folder, least=20.0)


@R.query(
    "sql_params",
    """SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'view') AND value > 12.5 AND event_id >= 100
       AND ts >= TIMESTAMP '2024-01-03 00:00:00'""",
)
def sql_params(spark, folder):
    """Parameters of every kind, bound by name and never put into the text."""
    return sql_step(
        spark,
        {"events": table(spark, folder, "events")},
        """SELECT event_id, event_type, value FROM events
           WHERE array_contains(:types, event_type) AND value > :least AND event_id >= :start AND (ts >= CAST(:since AS TIMESTAMP_NTZ) OR NOT :timed)""",
        parameters={
            "types": F.array(F.lit("error"), F.lit("view")), "least": 12.5, "start": 100,
            "since": "2024-01-03 00:00:00", "timed": True,
        },
        functions=False,
    )


@R.query("stream_alert", "SELECT 'large errors' AS result, count(*) AS rows_found, count(*) > 0 AS found FROM events WHERE event_type = 'error' AND value > 100")
def stream_alert(spark, folder):
    """Rows found since the last run; everything is new to the first one."""
    schema = table(spark, folder, "events").schema
    stream = read_events(spark, folder, "events.parquet", schema).where("event_type = 'error' AND value > 100")
    path = new_path(spark, "alert")
    run_alert(stream, "large errors", path, new_path(spark, "alert-state"))
    found = spark.read.parquet(path)
    return found.groupBy("result").agg(F.sum("rows_found").alias("rows_found")).withColumn("found", F.col("rows_found") > 0)


@R.query(
    "stream_bucket",
    """SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""",
)
def stream_bucket(spark, folder):
    """Hourly buckets of a stream; the newest version of every bucket."""
    schema = table(spark, folder, "events").schema
    stream = read_events(spark, folder, "events.parquet", schema)
    sums = [F.count("*").alias("n"), F.sum("value").alias("total")]
    path = new_path(spark, "buckets")
    run_updates(bucket_stream(stream, "ts", "1 hour", ["event_type"], "2 hours", sums), path, new_path(spark, "bucket-state"))
    out = latest_buckets(spark, path, ["bucket", "event_type"])
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 2).alias("total"))


@R.query(
    "stream_alert_once",
    """SELECT user_id, ts AS alert_at FROM events WHERE event_type = 'error'
       QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true)""",
)
def stream_alert_once(spark, folder):
    """One alert when a user's errors begin, and again after six hours without any."""
    schema = table(spark, folder, "events").schema
    stream = read_events(spark, folder, "events.parquet", schema).where("event_type = 'error'")
    path = new_path(spark, "alerts")
    run_append(alert_once(stream, ["user_id"], "ts", 6 * 3600, "1 hour"), path, new_path(spark, "alerts-state"))
    return spark.read.parquet(path).select("user_id", F.col("alert_at").cast("timestamp_ntz").alias("alert_at"))


@R.query(
    "chain_reuse",
    """WITH hours AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY ALL),
       top AS (SELECT event_type, max(n) AS most FROM hours GROUP BY ALL), days AS (SELECT event_type, date_trunc('day', hour) AS day, sum(n) AS n FROM hours GROUP BY ALL)
       SELECT days.event_type, day, CAST(days.n AS BIGINT) AS n, most FROM days JOIN top ON days.event_type = top.event_type""",
)
def chain_reuse(spark, folder):
    """Hourly counts that two later steps read are worked out once; a second chain scans them."""
    store = new_path(spark, "steps")

    def hours(results):
        counted = results["events"].where("value > 10").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        return counted.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))

    steps = [
        Step("hours", hours),
        Step("top", lambda r: r["hours"].groupBy("event_type").agg(F.max("n").alias("most"))),
        Step("days", lambda r: r["hours"].groupBy("event_type", F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day")).agg(F.sum("n").alias("n"))),
        Step("report", lambda r: r["days"].join(r["top"], "event_type").select("event_type", "day", "n", "most")),
    ]
    run_chain_reused(steps, store, {"events": table(spark, folder, "events")})
    return run_chain_reused(steps, store, {"events": table(spark, folder, "events")})["report"]
