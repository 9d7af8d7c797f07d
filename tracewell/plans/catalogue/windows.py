"""Ordered queries. Group sizes are checked; hot groups are cut into slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.aggregate import aggregate
from tracewell.operators.frames import Distinct, Frame, Quantile, moving_holistic
from tracewell.operators.ordered import moving_range, rank_rows, running_totals
from tracewell.operators.paging import deep_page
from tracewell.operators.ranges import asof_join
from tracewell.operators.rows import newest
from tracewell.operators.sampling import sample_rows, sample_strata
from tracewell.operators.shift import shift
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import ALERTS, alerts, table

R = Registry()


@R.query(
    "shift_group",
    f"""WITH {ALERTS}
    SELECT pid, CASE WHEN host IS NULL THEN 'none' ELSE
      coalesce(lag(rule, 2) OVER (PARTITION BY host ORDER BY ts, pid), 'none') END AS shifted FROM alerts""",
)
def shift_group(spark, folder):
    """Rule of the alert two before on the same host; no host gives the filler."""
    out = shift(alerts(spark, folder), ["host.hostname"], "rule.name", "shifted", 2, ["@timestamp", "process.pid"], "none")
    return out.select(F.col("`process.pid`").alias("pid"), "shifted")


@R.query(
    "shift_lead",
    """SELECT event_id, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS next_value FROM events""",
)
def shift_lead(spark, folder):
    out = shift(table(spark, folder, "events"), ["user_id"], "value", "next_value", -1, ["ts", "event_id"], -1)
    return out.select("event_id", "next_value")


@R.query(
    "shift_all",
    "SELECT event_id, coalesce(lag(event_type, 3) OVER (ORDER BY ts, event_id), '') AS shifted FROM events",
)
def shift_all(spark, folder):
    """Shift over the whole table, without one window over everything at scale."""
    out = shift(table(spark, folder, "events"), [], "event_type", "shifted", 3, ["ts", "event_id"], "")
    return out.select("event_id", "shifted")


@R.query(
    "sql_rank",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey,
              row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_number,
              rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank,
              cume_dist() OVER w AS cume_dist,
              ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS quarter
       FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate)""",
)
def sql_rank(spark, folder):
    """Ranks of a supplier's lines by date, and quarters."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey")
    ranked = rank_rows(lines, ["l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber"], tiles=4)
    return ranked.withColumnRenamed("ntile", "quarter")


@R.query(
    "sql_frame",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
              count(*) OVER d AS day_count, max(value) OVER d AS day_max
       FROM events WINDOW d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
)
def sql_frame(spark, folder):
    """A running sum and a one-day moving frame per user."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    running = running_totals(events, ["user_id"], ["ts", "event_id"], {"running": F.col("value")})
    frames = {"day_count": ("count", F.lit(1)), "day_max": ("max", F.col("value"))}
    out = moving_range(running, ["user_id"], "ts", 86_400, frames)
    return out.select("event_id", F.round("running", 2).alias("running"), "day_count", "day_max")


@R.query(
    "topk",
    "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 10",
)
def topk(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return newest(orders, ["o_orderdate", "o_orderkey"], 50, 10)


@R.query(
    "page_deep",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
       ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 500 OFFSET 40000""",
)
def page_deep(spark, folder):
    """A page from the depth of the list; small parts, so that it is searched at any size of the table."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return deep_page(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], 500, 40_000, few=2_000)


@R.query(
    "sample_rows",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       ORDER BY md5(concat_ws('|', '11', l_orderkey, l_linenumber)) LIMIT 2500""",
)
def sample_of_rows(spark, folder):
    """Exactly 2,500 random lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sample_rows(lines, 2_500, ["l_orderkey", "l_linenumber"], 11)


@R.query(
    "sample_strata",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, md5(concat_ws('|', '5', o_orderkey)) AS h FROM orders)
       SELECT 'share' AS kind, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM o
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY h) <= ceil(0.05 * count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority))
       UNION ALL SELECT 'rows', o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM o
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY h) <= 300""",
)
def sample_of_strata(spark, folder):
    """A twentieth of each status and priority, and 300 orders of each status."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    share = sample_strata(orders, ["o_orderstatus", "o_orderpriority"], 0.05, ["o_orderkey"], 5)
    rows = sample_strata(orders, ["o_orderstatus"], 300, ["o_orderkey"], 5)
    names = ["kind", *orders.columns]
    return share.withColumn("kind", F.lit("share")).select(names).unionByName(rows.withColumn("kind", F.lit("rows")).select(names))


# The same operators with a limit so small that groups are cut into slices at any size of the tables.
CUT_ROWS = 400


@R.query(
    "shift_cut",
    """SELECT event_id, lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before,
              lead(value, 1) OVER (ORDER BY ts, event_id) AS after FROM events""",
)
def shift_cut(spark, folder):
    """Shifts within types and over the whole table, from slices."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    one = shift(events, ["event_type"], "value", "before", 2, ["ts", "event_id"], rows_per_task=CUT_ROWS)
    return shift(one, [], "value", "after", -1, ["ts", "event_id"], rows_per_task=CUT_ROWS).select("event_id", "before", "after")


@R.query(
    "rank_cut",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_number,
              rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist,
              ntile(4) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS quarter
       FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate)""",
)
def rank_cut(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    ranked = rank_rows(lines, ["l_returnflag"], "l_shipdate", ["l_orderkey", "l_linenumber"], tiles=4, rows_per_task=CUT_ROWS)
    return ranked.drop("l_returnflag", "l_shipdate").withColumnRenamed("ntile", "quarter")


@R.query(
    "frame_cut",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
              count(*) OVER d AS hour_count, max(value) OVER d AS hour_max
       FROM events WINDOW d AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
)
def frame_cut(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    running = running_totals(events, ["event_type"], ["ts", "event_id"], {"running": F.col("value")}, rows_per_task=CUT_ROWS)
    frames = {"hour_count": ("count", F.lit(1)), "hour_max": ("max", F.col("value"))}
    out = moving_range(running, ["event_type"], "ts", 3_600, frames, rows_per_task=CUT_ROWS)
    return out.select("event_id", F.round("running", 2).alias("running"), "hour_count", "hour_max")


@R.query("median_cut", "SELECT l_returnflag, median(l_extendedprice) AS price, median(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag")
def median_cut(spark, folder):
    lines = table(spark, folder, "lineitem")
    out = aggregate(lines, ["l_returnflag"], {"l_extendedprice": "median", "l_quantity": "median"}, rows_per_task=CUT_ROWS)
    return out.toDF("l_returnflag", "price", "quantity")


@R.query(
    "asof_cut",
    """SELECT v.event_id, c.event_id AS last_error FROM events v
       ASOF LEFT JOIN (SELECT event_id, user_id % 3 AS grp, ts FROM events WHERE event_type = 'error') c
       ON v.user_id % 3 = c.grp AND v.ts >= c.ts WHERE v.event_type <> 'error'""",
)
def asof_cut(spark, folder):
    events = table(spark, folder, "events").withColumn("grp", F.col("user_id") % 3)
    others = events.where("event_type <> 'error'").select("event_id", "grp", "ts")
    errors = events.where("event_type = 'error'").selectExpr("grp", "ts AS at", "event_id AS last_error")
    out = asof_join(others, errors, ["grp"], "ts", "at", ["last_error"], "last_error", CUT_ROWS)
    return out.select("event_id", "last_error")


@R.query(
    "frame_median",
    """SELECT event_id, round(median(value) OVER near, 6) AS near_median, round(quantile_cont(value, 0.9) OVER day, 6) AS day_high,
              round(median(value) OVER sofar, 6) AS running_median, count(DISTINCT user_id) OVER near AS near_users
       FROM events WINDOW near AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 5 FOLLOWING),
         day AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 HOUR FOLLOWING),
         sofar AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def frame_median(spark, folder):
    """Holistic frames per type: by rows, by time, and from the first row on, from cut groups."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "user_id", "value")
    near, hour = Frame(20, 5), 3_600_000_000
    out = moving_holistic(
        events, ["event_type"], ["ts", "event_id"],
        {
            "near_median": Quantile("value", near),
            "day_high": Quantile("value", Frame(24 * hour, hour, by_value=True), 0.9),
            "running_median": Quantile("value", Frame(None, 0)),
            "near_users": Distinct("user_id", near),
        },
    )
    shown = [F.round(n, 6).alias(n) for n in ("near_median", "day_high", "running_median")]
    return out.select("event_id", *shown, "near_users")
