"""Joins, apply and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.apply import Bind, apply_equal, apply_lateral, apply_within, bind_parameters, unique_output
from tracewell.operators.ordered import as_number
from tracewell.operators.ranges import asof_join, overlap_join, range_join
from tracewell.operators.rows import union_tagged
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import table

R = Registry()

R.sql(
    "join_inner",
    """SELECT o.o_orderkey, c.c_name, n.n_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
R.sql(
    "join_left",
    """SELECT c.c_custkey, count(o.o_orderkey) AS orders_count FROM customer c
       LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey""",
)
R.sql(
    "join_right",
    """SELECT l.quality, d.doc_id, d.lang FROM labels l RIGHT JOIN documents d USING (doc_id)""",
)
R.sql(
    "join_full",
    """SELECT coalesce(e.user_id, c.c_custkey) AS id, e.n, c.c_mktsegment
       FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e
       FULL JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000) c ON e.user_id = c.c_custkey""",
)
R.sql(
    "join_theta",
    """SELECT o.o_orderkey, l.l_linenumber, o.o_orderdate, l.l_shipdate FROM orders o
       JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate < o.o_orderdate + INTERVAL '30' DAY AND l.l_quantity > 10""",
)
R.sql(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
)
R.sql("join_anti", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")


@R.query(
    "join_self",
    """SELECT a.event_id, b.event_id AS pair_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR""",
)
def join_self(spark, folder):
    """Pairs of a user's like events within an hour: a range join, so that no
    user's events are all compared with each other."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    later = events.selectExpr("event_id AS pair_id", "user_id AS u", "event_type AS e", "ts AS later")
    start = as_number(events, "ts")
    hour = 3600 * 1e6
    pairs = range_join(events, later, [("user_id", "u"), ("event_type", "e")], start + F.lit(1.0), start + F.lit(hour), "later", hour)
    return pairs.select("event_id", "pair_id")


@R.query(
    "join_asof",
    """SELECT v.event_id, c.event_id AS last_error, c.value AS last_value
       FROM events v ASOF LEFT JOIN (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error') c
       ON v.user_id = c.user_id AND v.ts >= c.ts WHERE v.event_type <> 'error'""",
)
def join_asof(spark, folder):
    """Last error of the user at or before every other event."""
    events = table(spark, folder, "events")
    others = events.where("event_type <> 'error'").select("event_id", "user_id", "ts")
    errors = events.where("event_type = 'error'").selectExpr("user_id", "ts AS at", "event_id AS last_error", "value AS last_value")
    out = asof_join(others, errors, ["user_id"], "ts", "at", ["last_error", "last_value"], "last_error")
    return out.select("event_id", "last_error", "last_value")


@R.query(
    "join_range",
    """SELECT o.o_orderkey, l.l_orderkey, l.l_linenumber FROM orders o JOIN lineitem l
       ON l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 3 DAY AND l.l_suppkey = o.o_custkey""",
)
def join_range(spark, folder):
    """Lines of a supplier shipped within three days of an order with the same number."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    start = as_number(orders, "o_orderdate")
    three_days = 3 * 86_400 * 1e6
    out = range_join(orders, lines, [("o_custkey", "l_suppkey")], start, start + F.lit(three_days), "l_shipdate", three_days)
    return out.select("o_orderkey", "l_orderkey", "l_linenumber")


@R.query(
    "join_overlap",
    """SELECT o.o_orderkey, l.l_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_suppkey = o.o_custkey
       AND o.o_orderdate <= l.l_shipdate + to_days(CAST(l.l_quantity AS INT))
       AND l.l_shipdate <= o.o_orderdate + to_days(CAST(o.o_orderkey % 400 AS INT))""",
)
def join_overlap(spark, folder):
    """Orders open for up to 400 days, and the lines of the supplier with the same number that were under way meanwhile."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    ordered, shipped, day = as_number(orders, "o_orderdate"), as_number(lines, "l_shipdate"), 86_400 * 1e6
    open_for = (ordered, ordered + F.col("o_orderkey") % 400 * F.lit(day))
    under_way = (shipped, shipped + F.col("l_quantity").cast("int") * F.lit(day))
    out = overlap_join(orders, lines, [("o_custkey", "l_suppkey")], open_for, under_way, 30 * day)
    return out.select("o_orderkey", "l_orderkey", "l_linenumber")


@R.query(
    "apply_lateral",
    """SELECT c.c_custkey AS applied_customer, o.o_orderstatus, o.n, o.top FROM customer c, LATERAL (
         SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c.c_custkey GROUP BY o_orderstatus) o""",
)
def apply_subquery(spark, folder):
    """An aggregate query for every customer, as one join."""
    bound = bind_parameters(table(spark, folder, "customer"), [Bind("c_custkey", "customer")], "customers")
    orders = table(spark, folder, "orders")
    return apply_lateral(
        bound,
        {"orders": table(spark, folder, "orders")},
        """SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders
           WHERE o_custkey = bound.applied_customer GROUP BY o_orderstatus""",
    )


@R.query(
    "apply_pattern",
    """SELECT c_custkey, c_acctbal, printf('Customer#%09d', o_custkey) AS applied_name,
              concat('orders:o_custkey>', o_custkey) AS applied_label FROM orders
       JOIN customer ON c_name = printf('Customer#%09d', o_custkey)
       QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_custkey) = 1""",
)
def apply_with_pattern(spark, folder):
    """Customers by a name made from each order through a pattern, repeats dropped."""
    orders = table(spark, folder, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("padded"), "o_custkey")
    bound = bind_parameters(
        orders,
        [
            Bind("padded", "name", "Customer#%(__pattern_value__)s"),
            Bind("o_custkey", "label", "%(__pattern_data__)s:%(__pattern_column__)s>%(__pattern_value__)s"),
        ],
        "orders",
    )
    # Equal bindings give equal rows: dropping them first keeps the join small.
    found = apply_equal(bound.distinct(), table(spark, folder, "customer"), {"applied_name": "c_name"})
    rows = found.select("c_custkey", "c_acctbal", "applied_name", "applied_label")
    return unique_output(rows, ["c_custkey"], ["c_custkey"])


@R.query(
    "apply_window",
    """SELECT e.event_id, e.event_type, a.user_id AS applied_user, a.ts AS applied_at, a.event_id AS applied_id
       FROM events a JOIN events e ON e.user_id = a.user_id
        AND e.ts BETWEEN a.ts - INTERVAL 600 SECOND AND a.ts + INTERVAL 60 SECOND""",
)
def apply_around(spark, folder):
    """For every event, the same user's events from ten minutes before to one after."""
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", "ts")
    binds = [Bind("user_id", "user"), Bind("ts", "at"), Bind("event_id", "id")]
    bound = bind_parameters(events, binds, "events")
    out = apply_within(bound, events, {"applied_user": "user_id"}, "applied_at", "ts", 600, 60)
    return out.select("event_id", "event_type", "applied_user", "applied_at", "applied_id")


@R.query(
    "union_tagged",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL AS size, 'customers' AS _data_name_ FROM customer
       UNION ALL SELECT p_partkey, p_name, NULL, p_size, 'parts' FROM part
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'suppliers' FROM supplier""",
)
def union_named(spark, folder):
    return union_tagged(
        {
            "customers": table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance"),
            "parts": table(spark, folder, "part").selectExpr("p_partkey AS key", "p_name AS name", "p_size AS size"),
            "suppliers": table(spark, folder, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance"),
        }
    )


R.sql(
    "sql_union",
    """SELECT c_nationkey AS nation, 'customer' AS kind FROM customer WHERE c_acctbal > 9000
       UNION SELECT s_nationkey, 'supplier' FROM supplier
       UNION ALL SELECT n_nationkey, 'nation' FROM nation""",
)
R.sql("sql_intersect", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity <= 25")
R.sql("sql_except", "SELECT o_custkey AS id FROM orders EXCEPT ALL SELECT user_id FROM events")
