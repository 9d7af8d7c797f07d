"""Nested values, documents, lines and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.reshape import (
    custom_fields, display_cells, dotted, flatten_underscored, fold_history, matching_lines, normalize_columns,
    parent_child, prompts, rename_copies, text_values, with_link,
)
from tracewell.operators.validate import Rule, validate
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import table
from tracewell.sources.documents import api_rows, first_response_rows, frame_labels, unwrap_hits

R = Registry()


@R.query(
    "hits_flatten",
    """SELECT CAST(event_id AS VARCHAR) AS _id, event_type AS kind, value,
              CASE WHEN event_id % 3 = 0 THEN concat('["', event_type, '","audit"]') ELSE event_type END AS tags FROM events""",
)
def hits_flatten(spark, folder):
    """Each response holds a hit with fields and one without."""
    responses = table(spark, folder, "events").selectExpr(
        """named_struct('hits', array(
             named_struct('_id', cast(event_id AS string), 'fields', named_struct('kind', array(event_type), 'value', array(value),
               'tags', CASE WHEN event_id % 3 = 0 THEN array(event_type, 'audit') ELSE array(event_type) END)),
             named_struct('_id', concat('none-', event_id), 'fields', NULL))) AS hits"""
    )
    return unwrap_hits(responses)


@R.query("json_rows", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def json_rows(spark, folder):
    """Rows of SQL-over-HTTP answers: the data list of the first element."""
    answers = table(spark, folder, "orders").selectExpr(
        """to_json(array(named_struct('data', array(named_struct('id', o_orderkey, 'status', o_orderstatus, 'price', o_totalprice)),
             'total', 1))) AS body"""
    )
    return first_response_rows(answers, "body", "id BIGINT, status STRING, price DOUBLE")


@R.query(
    "frame_labels",
    """SELECT c_name AS host, c_mktsegment AS job FROM customer WHERE c_custkey % 2 = 0 UNION ALL
       SELECT c_name, NULL FROM customer""",
)
def frame_label_rows(spark, folder):
    """Frames of customers: a field with two labels or none, one with a single label."""
    frames = table(spark, folder, "customer").selectExpr(
        """array(named_struct('schema', named_struct('fields', array(
             named_struct('labels', CASE WHEN c_custkey % 2 = 0 THEN map('host', c_name, 'job', c_mktsegment) END),
             named_struct('labels', map('host', c_name)))))) AS frames"""
    )
    return frame_labels(frames, "frames", ["host", "job"])


@R.query(
    "api_link",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('ISSUE-', o_orderkey) END AS idReadable, o_orderpriority AS summary,
              CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE concat('https://tracker.example.com/issue/ISSUE-', o_orderkey, '/') END AS link FROM orders""",
)
def api_link(spark, folder):
    """Tracker answers as lists and single objects, with a link per row."""
    one = "to_json(named_struct('idReadable', CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('ISSUE-', o_orderkey) END, 'summary', o_orderpriority))"
    answers = table(spark, folder, "orders").selectExpr(f"CASE WHEN o_orderkey % 2 = 0 THEN concat('[', {one}, ']') ELSE {one} END AS body")
    rows = api_rows(answers, "body", "idReadable STRING, summary STRING")
    return with_link(rows, "https://tracker.example.com", "issue")


def nested_orders(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "named_struct('id', o_custkey, 'state', named_struct('code', o_orderstatus, 'text', o_orderpriority)) AS buyer",
        "CASE WHEN o_orderkey % 2 = 0 THEN array(o_totalprice) WHEN o_orderkey % 3 = 0 THEN array() ELSE array(o_totalprice, 0.5D) END AS prices",
        "array(named_struct('n', o_orderkey + 1, 't', array(o_orderstatus, 'x'))) AS marks",
    )


@R.query(
    "json_flatten",
    """SELECT o_orderkey, o_custkey AS buyer_id, o_orderstatus AS buyer_state_code, o_orderpriority AS buyer_state_text,
              CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN o_totalprice END AS prices_0,
              CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN 0.5::DOUBLE END AS prices_1,
              o_orderkey + 1 AS marks_0_n, o_orderstatus AS marks_0_t_0, 'x' AS marks_0_t_1 FROM orders""",
)
def json_flatten(spark, folder):
    return flatten_underscored(nested_orders(spark, folder))


@R.query(
    "json_dotted",
    """SELECT o_orderkey, o_custkey AS buyer__id, o_orderstatus AS buyer__state__code, o_orderpriority AS buyer__state__text,
              CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS prices_kept FROM orders""",
)
def json_dotted(spark, folder):
    """Dotted columns, shown here with '__' for '.'; lists are kept (their size is shown)."""
    out = dotted(nested_orders(spark, folder)).drop("marks").withColumn("prices_kept", F.size("prices")).drop("prices")
    return out.toDF(*[c.replace(".", "__") for c in out.columns])


@R.query(
    "history_fold",
    """SELECT event_id, event_type AS kind, '2' AS changes, concat(event_id, '.5') AS first_time, CAST(value AS VARCHAR) AS first_value,
              CAST(user_id AS VARCHAR) AS first_user, concat(event_id + 1, '.25') AS last_time, 'closed' AS last_state FROM events""",
)
def history_fold(spark, folder):
    """Alert maps with modification keys of two times; the first has two fields."""
    alerts = table(spark, folder, "events").selectExpr(
        "event_id",
        """map('kind', event_type,
               concat('modification_history_', event_id, '.5_value'), cast(value AS string),
               concat('modification_history_', event_id, '.5_user_id'), cast(user_id AS string),
               concat('modification_history_', event_id + 1, '.25_state'), 'closed') AS entries""",
    )
    folded = fold_history(alerts, "entries")
    return folded.selectExpr(
        "event_id", "fields['kind'] AS kind", "cast(size(modification_history) AS string) AS changes",
        "modification_history[0].timestamp AS first_time", "modification_history[0].fields['value'] AS first_value",
        "modification_history[0].fields['user_id'] AS first_user", "modification_history[1].timestamp AS last_time",
        "modification_history[1].fields['state'] AS last_state",
    )


@R.query(
    "eav_pivot",
    """SELECT o_orderkey, concat('USER-', o_custkey) AS reporter_login, concat(o_orderstatus, '/tag') AS reporter_tags,
              o_orderpriority AS Priority, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS State,
              CASE WHEN o_custkey > 0 THEN CAST(o_custkey AS VARCHAR) END AS Estimate FROM orders""",
)
def eav_pivot(spark, folder):
    """Issues with nested objects and a list of custom fields."""
    issues = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        """named_struct('$type', 'User', 'login', concat('USER-', o_custkey), 'inner', named_struct('x', 1),
             'tags', array(named_struct('name', o_orderstatus), named_struct('name', 'tag'))) AS reporter""",
        "array(1, 2) AS votes",
        """array(named_struct('name', 'Priority', 'value', to_json(named_struct('name', o_orderpriority, 'id', 1))),
             named_struct('name', 'State', 'value', CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE concat('"', o_orderstatus, '"') END),
             named_struct('name', 'Estimate', 'value', cast(o_custkey AS string))) AS customFields""",
    )
    return custom_fields(parent_child(issues, keep=["customFields"]), "customFields", ["Priority", "State", "Estimate"])


@R.query(
    "line_grep",
    """WITH l AS (SELECT doc_id, source, unnest(string_split_regex(text, '\\r\\n|[\\n\\x{0B}\\f\\r\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]')) AS line,
                         generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\x{0B}\\f\\r\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]'), 1) - 1 AS line_no FROM documents)
       SELECT doc_id, source, line_no, line FROM l WHERE contains(line, 'the')""",
)
def line_grep(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return matching_lines(docs, "text", "the").withColumn("line_no", F.col("line_no").cast("bigint"))


@R.query(
    "prompt_rows",
    """SELECT l_orderkey, concat('Look at one order.', chr(10), chr(10), '| l_linenumber | l_returnflag | l_suppkey |', chr(10), '|:---|:---|:---|', chr(10),
              string_agg(concat('| ', l_linenumber, ' | ', l_returnflag, ' | ', l_suppkey, ' |'), chr(10) ORDER BY l_linenumber, l_suppkey, l_partkey),
              chr(10), chr(10), 'These are its lines.', chr(10), chr(10), 'What is odd?') AS prompt FROM lineitem GROUP BY l_orderkey""",
)
def prompt_rows(spark, folder):
    """One prompt per order, its lines as a Markdown table."""
    return prompts(
        table(spark, folder, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"],
        ["l_linenumber", "l_returnflag", "l_suppkey"],
        scenario=("Look at one order.", None), step=(None, "These are its lines."), main="What is odd?",
    )


@R.query(
    "display_cells",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS "user",
              concat('["', event_type, '","audit"]') AS tags, props FROM events""",
)
def cells(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "event_id AS id", "CASE WHEN user_id % 7 <> 0 THEN user_id END AS user", "array(event_type, 'audit') AS tags", "props"
    )
    return display_cells(events)


@R.query(
    "norm_columns",
    """SELECT c_custkey AS Host, c_name AS host_0, CASE WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END AS "Key", c_acctbal AS key_1 FROM customer""",
)
def norm_columns(spark, folder):
    """Host/host and Key/key collide in SQL; null text becomes ''."""
    same = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS k", "c_acctbal"
    ).toDF("Host", "host", "Key", "key")
    return normalize_columns(same, to_text_columns=True)


@R.query(
    "norm_mssql",
    """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
              event_type FROM events""",
)
def norm_mssql(spark, folder):
    """Times to ISO text, bytes to text in the source's encoding."""
    return text_values(table(spark, folder, "events").selectExpr("event_id", "ts", "encode(event_type, 'UTF-16LE') AS event_type"), "UTF-16LE")


@R.query(
    "copy_column",
    "SELECT c_custkey, c_name, c_name AS host, c_custkey AS id FROM customer",
)
def copy_column(spark, folder):
    return rename_copies(table(spark, folder, "customer").select("c_custkey", "c_name"), {"host": "c_name", "id": "c_custkey"})


@R.query(
    "validate_cols",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END, 'none') AS label,
              concat_ws('; ', CASE WHEN o_orderkey % 4 <> 0 AND length(o_orderpriority) > 8 THEN 'label: longer than 8' END,
                CASE WHEN o_orderkey % 5 = 0 THEN 'at: not a valid datetime' END,
                CASE WHEN o_orderkey % 7 = 0 THEN 'count: required' WHEN o_orderkey % 3 = 0 THEN 'count: not a valid integer' END,
                CASE WHEN o_orderkey % 6 = 0 THEN 'ip: not a valid ip_address' END,
                CASE WHEN o_orderstatus = 'P' THEN 'share: not a valid float' END) AS violations FROM orders""",
)
def validate_cols(spark, folder):
    """Orders as text parameters of five types, some bad, some missing."""
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS label",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'yesterday' ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS at",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '1.5' ELSE cast(o_custkey AS string) END AS count",
        "CASE WHEN o_orderkey % 6 = 0 THEN '10.0.0' ELSE '::1' END AS ip",
        "CASE WHEN o_orderstatus = 'P' THEN 'p' ELSE cast(o_totalprice AS string) END AS share",
    )
    rules = {
        "label": Rule("string", required=False, default="none", max_length=8),
        "at": Rule("datetime", format="%Y-%m-%d %H:%M:%S"),
        "count": Rule("integer"),
        "ip": Rule("ip_address"),
        "share": Rule("float"),
    }
    return validate(rows, rules).select("o_orderkey", "label", F.concat_ws("; ", "violations").alias("violations"))
