"""Families of the SQL a step may use, as Spark SQL with the DuckDB form next to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import table
from tracewell.session import cut_lineage

R = Registry()

R.sql(
    "sql_filter",
    """SELECT p_partkey, p_name, p_brand, p_size FROM part
       WHERE p_size BETWEEN 5 AND 30 AND p_type IN ('ECONOMY', 'SMALL') AND (p_name LIKE '%ring' OR NOT p_brand = 'Brand#4') AND p_retailprice IS NOT NULL""",
)
R.sql(
    "sql_string",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 10, 5) AS part, replace(c_name, '#', '-') AS dashed,
              trim(concat('  ', c_mktsegment, ' ')) AS trimmed, concat_ws('/', c_mktsegment, c_name) AS path, CAST(length(c_name) AS BIGINT) AS len,
              lpad(CAST(c_nationkey AS STRING), 4, '0') AS padded, split(c_name, '#')[1] AS number, CAST(instr(c_name, '#') AS BIGINT) AS at,
              reverse(c_mktsegment) AS backwards FROM customer""",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substr(c_name, 10, 5) AS part, replace(c_name, '#', '-') AS dashed,
              trim(concat('  ', c_mktsegment, ' ')) AS trimmed, concat_ws('/', c_mktsegment, c_name) AS path, length(c_name) AS len,
              lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, string_split(c_name, '#')[2] AS number, instr(c_name, '#') AS at,
              reverse(c_mktsegment) AS backwards FROM customer""",
)
R.sql(
    "sql_date",
    """SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS month, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(extract(DOW FROM o_orderdate) - 1 AS BIGINT) AS dow,
              timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01', o_orderdate) AS days, date_format(o_orderdate, 'yyyy/MM/dd') AS text,
              o_orderdate + INTERVAL '1' DAY AS next_day, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders""",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, year(o_orderdate) AS y, date_part('dow', o_orderdate) AS dow,
              date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS days, strftime(o_orderdate, '%Y/%m/%d') AS text,
              o_orderdate + INTERVAL 1 DAY AS next_day, quarter(o_orderdate) AS q FROM orders""",
)
R.sql(
    "sql_math",
    """SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS fl, ceil(l_tax) AS ce, abs(l_discount - 0.05D) > 0.02D AS far, round(power(l_quantity, 2), 3) AS sq,
              round(ln(l_extendedprice + 1), 6) AS lg, CAST(l_orderkey % 7 AS BIGINT) AS md, round(try_divide(l_extendedprice, l_discount), 3) AS ratio, sign(l_discount) AS sg
       FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_tax) AS BIGINT) AS ce, abs(l_discount - 0.05::DOUBLE) > 0.02::DOUBLE AS far, round(power(l_quantity, 2), 3) AS sq,
              round(ln(l_extendedprice + 1), 6) AS lg, l_orderkey % 7 AS md, round(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END, 3) AS ratio, CAST(sign(l_discount) AS DOUBLE) AS sg
       FROM lineitem""",
)
R.sql(
    "sql_array",
    """SELECT d.doc_id, CAST(size(w) AS BIGINT) AS words, array_contains(w, 'the') AS has_the, array_join(slice(sort_array(array_distinct(w)), 1, 5), ' ') AS first_words,
              aggregate(w, CAST(0 AS BIGINT), (a, x) -> a + length(x)) AS letters
       FROM (SELECT doc_id, split(text, ' ') AS w FROM documents) d""",
    """SELECT doc_id, len(w) AS words, list_contains(w, 'the') AS has_the, array_to_string(list_sort(list_distinct(w))[1:5], ' ') AS first_words,
              CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters
       FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
R.sql(
    "sql_unnest",
    """SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM documents) GROUP BY word""",
    """SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""",
)
R.sql(
    "sql_map",
    """SELECT e.c_custkey, e.m['segment'] AS segment, k AS key, v AS value
       FROM (SELECT c_custkey, map_from_arrays(array('segment', 'name'), array(c_mktsegment, c_name)) AS m FROM customer) e LATERAL VIEW explode(m) x AS k, v""",
    """SELECT c_custkey, m['segment'] AS segment, u.key AS key, u.value AS value
       FROM (SELECT c_custkey, map(['segment', 'name'], [c_mktsegment, c_name]) AS m FROM customer), LATERAL (SELECT unnest(map_entries(m)) AS u)""",
)
R.sql(
    "sql_json",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1,
              variant_get(parse_json(props), '$.k', 'bigint') AS k2, get_json_object(props, '$.none') AS missing FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) + 1 AS k1,
              CAST(json_extract(props, '$.k') AS BIGINT) AS k2, props->>'$.none' AS missing FROM events""",
)
R.sql(
    "sql_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
              coalesce(nullif(o_orderstatus, 'F'), 'done') AS state, CAST(o_totalprice AS BIGINT) AS whole, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level,
              try_cast(o_orderstatus AS BIGINT) AS bad FROM orders""",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
              coalesce(nullif(o_orderstatus, 'F'), 'done') AS state, CAST(trunc(o_totalprice) AS BIGINT) AS whole, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level,
              try_cast(o_orderstatus AS BIGINT) AS bad FROM orders""",
)
R.sql(
    "sql_cte",
    """WITH spend AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
            named AS (SELECT c_name, c_nationkey, total FROM customer JOIN spend ON c_custkey = o_custkey)
       SELECT n_name, count(*) AS buyers, round(max(total), 2) AS best FROM named JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)


@R.query(
    "sql_rcte",
    """WITH RECURSIVE reach AS (
         SELECT c_custkey AS root, c_custkey AS id, 0 AS step FROM customer
         UNION ALL SELECT r.root, c.c_custkey, r.step + 1 FROM reach r JOIN customer c ON c.c_custkey = r.id // 2 WHERE r.id > 0 AND r.step < 5)
       SELECT root, id, step FROM reach""",
)
def sql_rcte(spark, folder):
    """Recursive CTE: five steps up from every customer along id / 2."""
    from tracewell.plans.steps import sql_step

    text = """WITH RECURSIVE reach AS (
         SELECT c_custkey AS root, c_custkey AS id, 0 AS step FROM customer
         UNION ALL SELECT r.root, c.c_custkey, r.step + 1 FROM reach r JOIN customer c ON c.c_custkey = r.id div 2 WHERE r.id > 0 AND r.step < 5)
       SELECT root, id, step FROM reach"""
    # The recursion is bounded by its depth; the engine's row guard is for endless ones.
    guard = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(guard)
    spark.conf.set(guard, "-1")
    try:
        return cut_lineage(sql_step(spark, {"customer": table(spark, folder, "customer")}, text, functions=False))
    finally:
        spark.conf.set(guard, before)


R.sql(
    "sql_subquery",
    """SELECT o.o_orderkey, o.o_totalprice, (SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS last_ship
       FROM orders o WHERE o.o_totalprice > (SELECT avg(o_totalprice) FROM orders)
         AND o.o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
         AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
)
R.sql(
    "sql_pivot",
    """SELECT * FROM (SELECT user_id, event_type FROM events)
       PIVOT (count(1) FOR event_type IN ('click' AS click, 'view' AS viewed, 'error' AS error))""",
    """SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS viewed,
              nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS error FROM events GROUP BY user_id""",
)
R.sql(
    "sql_unpivot",
    """SELECT s_suppkey, measure, amount FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS place FROM supplier)
       UNPIVOT (amount FOR measure IN (s_acctbal AS balance, place AS place))""",
    """SELECT s_suppkey, 'balance' AS measure, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'place', CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
R.sql(
    "sql_qualify",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM (
         SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
       WHERE place <= 3""",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3""",
)
R.sql(
    "sql_listagg",
    """SELECT l_orderkey, listagg(CAST(l_partkey AS STRING), ',') WITHIN GROUP (ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey""",
    """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey""",
)


@R.query("sql_sample", "SELECT count(*) AS orders, true AS all_are_orders, true AS each_once, true AS share_fits FROM orders")
def sql_sample(spark, folder):
    """Sampling: a random tenth, shown by what must hold for it: a subset, each row once, a share within six deviations."""
    orders = table(spark, folder, "orders")
    drawn = orders.sample(fraction=0.1, seed=7).select("o_orderkey", "o_totalprice")
    known = orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    facts = drawn.join(known, (F.col("o_orderkey") == F.col("key")) & (F.col("o_totalprice") == F.col("price")), "left").agg(
        F.count("*").alias("n"), F.count("key").alias("found"), F.count_distinct("o_orderkey").alias("keys")
    )
    return orders.agg(F.count("*").alias("orders")).join(facts).select(
        "orders",
        (F.col("found") == F.col("n")).alias("all_are_orders"),
        (F.col("keys") == F.col("n")).alias("each_once"),
        (F.abs(F.col("n") - 0.1 * F.col("orders")) <= 6 * F.sqrt(0.09 * F.col("orders"))).alias("share_fits"),
    )
