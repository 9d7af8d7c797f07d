"""Nested values, buckets, prompts, column checks."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators.buckets import DateHistogram, Terms, bucket_aggregate, flatten_buckets, request_layers
from tracewell.operators.reshape import (
    custom_fields, display_cells, dotted, flatten_underscored, fold_history, matching_lines, normalize_columns,
    parent_child, prompts, rename_copies, text_values, with_link,
)
from tracewell.operators.validate import Rule, validate
from tracewell.sources.documents import api_rows, first_response_rows, frame_labels, unwrap_hits


def test_dotted_and_underscored(spark):
    df = spark.sql("""SELECT 1 AS id, named_struct('b', named_struct('c', 'x'), 'l', array(1, 2)) AS a
        UNION ALL SELECT 2, named_struct('b', named_struct('c', NULL), 'l', array())""")
    assert dotted(df).columns == ["id", "a.b.c", "a.l"]
    flat = flatten_underscored(df)
    assert flat.columns == ["id", "a_b_c", "a_l_0", "a_l_1"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, "x", 1, 2), (2, None, None, None)]


def test_history(spark):
    df = spark.sql("""SELECT 1 AS id, map('title', 't', 'modification_history_1.5_action', 'open', 'modification_history_1.5_user_name', 'ann',
        'modification_history_2.5_action', 'close') AS m UNION ALL SELECT 2, map('title', 'u')""")
    rows = {r["id"]: r for r in fold_history(df, "m").collect()}
    history = [(h["timestamp"], h["fields"]) for h in rows[1]["modification_history"]]
    assert history == [("1.5", {"action": "open", "user_name": "ann"}), ("2.5", {"action": "close"})]
    assert rows[2]["modification_history"] == [] and rows[2]["fields"] == {"title": "u"}
    flat = flatten_underscored(fold_history(df, "m").select("id", "modification_history"))
    assert "modification_history_1_timestamp" in flat.columns


def test_custom_fields(spark):
    values = [("State", '{"name": "Open", "id": "1"}'), ("Empty", "null"), ("Zero", "0"), ("Text", '"a \\"b\\""'), ("Num", "5"),
              ("List", '[{"name": "x"}]'), ("NoName", '{"id": "2"}')]
    df = spark.createDataFrame([(1, [dict(name=n, value=v) for n, v in values])], "id int, f array<struct<name: string, value: string>>")
    row = custom_fields(df, "f").first().asDict()
    assert row == {"id": 1, "State": "Open", "Empty": None, "Zero": None, "Text": 'a "b"', "Num": "5", "List": '[{"name": "x"}]', "NoName": None}
    nested = spark.sql("SELECT 1 AS id, named_struct('$type', 'U', 'login', 'ann', 'o', named_struct('x', 1), 'g', array(named_struct('name', 'a'), named_struct('name', 'b'))) AS by, array(1) AS l")
    assert parent_child(nested).first().asDict() == {"id": 1, "by_login": "ann", "by_g": "a/b"}


def test_lines(spark):
    text = "owner: a\r\nother\nmy owner\x0bowner2 owner3"
    df = spark.createDataFrame([("f1", text), ("f2", "nothing")], "file string, text string")
    got = [(r["line_no"], r["line"]) for r in matching_lines(df, "text", "owner").orderBy("line_no").collect()]
    assert got == [(i, line) for i, line in enumerate(text.splitlines()) if "owner" in line]


def test_prompts(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, None), ("h", 1, "c")], "g string, n int, v string")
    out = {r["g"]: r["prompt"] for r in prompts(df, ["g"], ["n"], ["n", "v"], "json", ("S1", "S2"), ("A", None), "ask").collect()}
    assert out["g"] == 'S1\n\nA\n\n[{"n":1,"v":null}, {"n":2,"v":"b"}]\n\nS2\n\nask'
    table = prompts(df, ["g"], ["n"], ["n", "v"]).where("g = 'g'").first()["prompt"]
    assert table.split("\n")[:4] == ["| n | v |", "|:---|:---|", "| 1 |  |", "| 2 | b |"]
    with pytest.raises(ValueError):
        prompts(df, ["g"], ["n"], ["n"], "xml")


def test_cells_and_columns(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS a, array(1, 2) AS b, map('k', 'v') AS c, 1.5D AS d")
    assert tuple(display_cells(df).first()) == ("", "[1,2]", '{"k":"v"}', "1.5")
    same = spark.createDataFrame([(1, None, "x", 4)], "a int, b string, c string, d int").toDF("Host", "host", "HOST", "d")
    out = normalize_columns(same, to_text_columns=True)
    assert out.columns == ["Host", "host_0", "HOST_1", "d"] and tuple(out.first()) == (1, "", "x", 4)
    times = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS a, TIMESTAMP_NTZ'2024-01-01 00:00:00.5' AS b, CAST('é' AS BINARY) AS c")
    assert tuple(text_values(times).first()) == ("2024-01-01T00:00:00", "2024-01-01T00:00:00.500000", "é")
    assert rename_copies(df, {"e": "d"}).columns == ["a", "b", "c", "d", "e"]
    with pytest.raises(ValueError):
        rename_copies(df, {"e": "zz"})
    assert with_link(df, "u", "issue").first()["link"] == "?"


def test_buckets(spark):
    events = spark.createDataFrame(
        [("a", "x", datetime.datetime(2024, 1, 1, 5), 1.0), ("a", "x", datetime.datetime(2024, 1, 1, 6), 3.0),
         ("a", "y", datetime.datetime(2024, 1, 2), 5.0), ("b", "z", datetime.datetime(2024, 1, 2), 7.0), (None, "z", None, 1.0)],
        "k string, u string, at timestamp_ntz, v double")
    out = bucket_aggregate(events, [Terms("k"), Terms("u", 1), DateHistogram("at", "D")], {"v": "avg"})
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", "x", datetime.datetime(2024, 1, 1), 2, 2.0), ("b", "z", datetime.datetime(2024, 1, 2), 1, 7.0)]


def test_bucket_responses(spark):
    request = {"k": {"terms": {"field": "kind"}, "aggs": {"u": {"terms": {"field": "user"}, "aggs": {"m": {"avg": {"field": "v"}}, "n": {"max": {"field": "w"}}}}}}}
    assert request_layers(request) == ([("k", "kind_terms"), ("u", "user_terms")], [("m", "v_avg"), ("n", "w_max")])
    inner = [{"key": "x", "doc_count": 2, "m": {"value": 1.5}, "n": {"value": 3, "value_as_string": "three"}}]
    body = {"aggregations": {"k": {"buckets": [{"key": "a", "doc_count": 2, "u": {"buckets": inner}}, {"key": "b", "doc_count": 0, "u": {"buckets": []}}]}}}
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps({"rawResponse": body}),), ("{}",)], "body string")
    rows = [r.asDict() for r in flatten_buckets(df, "body", request).collect()]
    assert rows == [{"kind_terms": "a", "user_terms": "x", "key_as_string": None, "doc_count": 2, "v_avg": "1.5", "w_max": "three"}] * 2


def test_payloads(spark):
    hits = spark.sql("""SELECT named_struct('hits', array(named_struct('_id', '1', 'fields', named_struct('a', array('x'), 'b', array(1, 2))),
        named_struct('_id', '2', 'fields', NULL))) AS hits""")
    assert [tuple(r) for r in unwrap_hits(hits).collect()] == [("1", "x", "[1,2]")]
    answer = spark.createDataFrame([('[{"data": [{"a": 1}, {"a": 2}]}, {"data": [{"a": 3}]}]',), ("[]",)], "b string")
    assert [r["a"] for r in first_response_rows(answer, "b", "a INT").collect()] == [1, 2]
    frames = spark.sql("""SELECT array(named_struct('schema', named_struct('fields', array(named_struct('labels', map('h', 'x')),
        named_struct('labels', CAST(NULL AS MAP<STRING, STRING>)))))) AS frames""")
    assert [tuple(r) for r in frame_labels(frames, "frames", ["h", "j"]).collect()] == [("x", None)]
    api = spark.createDataFrame([('[{"id": "A"}, {}]',), (' {"id": "B"}',)], "b string")
    assert sorted((r["id"] or "") for r in api_rows(api, "b", "id STRING").collect()) == ["", "A", "B"]


def test_validation(spark):
    rows = [("abc", "1", "1.5", "2024-01-01", "10.0.0.1", "[1]", '{"a": 1}', "x"), ("abcdef", "1.5", "z", "01.01.2024", "10.0.0", "{}", "[1]", ""),
            (None, None, None, None, None, None, None, None), ("ab", " 12 ", "1e3", "2024-02-30", "::1", "1", "x", None)]
    names = ["s", "i", "f", "d", "ip", "l", "m", "b"]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))
    rules = {"s": Rule("string", max_length=4), "i": Rule("integer"), "f": Rule("float", False), "d": Rule("datetime", False, "now", format="%Y-%m-%d"),
             "ip": Rule("ip_address", False, "client_ip"), "l": Rule("list", False, "[]"), "m": Rule("dict", False, "{}"), "b": Rule("boolean", False, "true")}
    out = {r["k"]: r for r in validate(df, rules, client_ip="127.0.0.1").collect()}
    assert out[0]["violations"] == []
    assert [v.split(":")[0] for v in out[1]["violations"]] == ["s", "i", "f", "d", "ip", "l", "m"]
    assert out[2]["violations"] == ["s: required", "i: required", "f: no default"]
    assert out[2]["ip"] == "127.0.0.1" and out[2]["l"] == "[]" and out[2]["d"] == datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d")
    assert [v.split(":")[0] for v in out[3]["violations"]] == ["d", "l", "m"]
    bad = {"ip": Rule("ip_address", False, "nowhere"), "f": Rule("float", False, "1.5d"), "b": Rule("boolean", False)}
    assert validate(df.where("k = 2"), bad).first()["violations"] == ["ip: not a valid ip_address", "f: not a valid float", "b: no default"]
    with pytest.raises(ValueError):
        validate(df, {"s": Rule("uuid")})
    assert F is not None


def test_first_top_level_aggregation_and_leaf_keys(spark):
    request = {
        "sizes": {"range": {"field": "size"}, "aggs": {"kinds": {"terms": {"field": "kind"}}, "top": {"max": {"field": "v"}}}},
        "other": {"terms": {"field": "user"}, "aggs": {"n": {"max": {"field": "w"}}}},
    }
    assert request_layers(request) == ([("sizes", "size_range"), ("kinds", "kind_terms")], [("top", "v_max")])
    flat = {"sizes": {"range": {"field": "size"}}, "other": request["other"]}
    body = '{"aggregations": {"sizes": {"buckets": [{"key": "*-5", "from": 0, "to": 5, "doc_count": 3}, {"key": "5-*", "from": 5, "doc_count": 1}]}, "other": {"buckets": []}}}'
    out = flatten_buckets(spark.createDataFrame([(body,)], "body string"), "body", flat, leaf_keys=["from", "to"])
    assert [(r["size_range"], r["doc_count"], r["from"], r["to"]) for r in out.collect()] == [("*-5", 3, "0", "5"), ("5-*", 1, "5", None)]
