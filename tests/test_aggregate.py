"""Grouped and time-bucketed aggregation against pandas."""

import pandas as pd
import pytest

from tracewell.operators.aggregate import aggregate, aggregate_by_time, lists_to_text
from tracewell.operators.rows import first_per_key, latest_per_key, union_tagged

ROWS = [
    ("a", 1, 2.0, ["x", "y"]), ("a", 2, None, ["x"]), (None, 3, 4.0, None), (None, 4, 1.5, []), ("b", 5, None, ["z"]),
    ("a", 6, 7.0, ["x", "y"]), ("a", 7, 2.0, ["x", "y"]),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "`host.name` string, id long, v double, tags array<string>")


def test_functions_match_pandas(table):
    functions = ["min", "max", "count", "sum", "mean", "median", "std", "var", "nunique", "first", "last"]
    out = aggregate(table, ["host.name"], {"v": functions, "id": ["size"]}, order_by=["id"])
    frame = pd.DataFrame(ROWS, columns=["host.name", "id", "v", "tags"])
    want = frame.groupby(["host.name"], dropna=False).agg({"v": functions}).reset_index()
    want.columns = ["host.name"] + [f"v_{f}" for f in functions]
    got = {r["host.name"]: r for r in out.collect()}
    assert len(got) == 3
    for _, row in want.iterrows():
        mine = got[None if pd.isna(row["host.name"]) else row["host.name"]]
        for f in functions:
            value = row[f"v_{f}"]
            assert (mine[f"v_{f}"] is None) if pd.isna(value) else (mine[f"v_{f}"] == pytest.approx(value)), f


def test_bare_function_keeps_name_and_fill(table):
    out = aggregate(table, ["host.name"], {"v": "max"}, fill="-")
    assert sorted(tuple(r) for r in out.collect()) == [("-", "4.0"), ("a", "7.0"), ("b", "-")]


def test_list_cells(table):
    out = lists_to_text(table, {"tags": "text", "host.name": "copy"})
    assert [r["text"] for r in out.orderBy("id").collect()] == ["x,y", "x", None, "", "z", "x,y", "x,y"]
    with pytest.raises(ValueError):
        aggregate(table, ["host.name"], {"v": ["first"]})


TIMES = ["2024-01-30T23:10:00.5", "2024-01-31T00:00:00.0", "2024-02-10T12:00:00.0", "2024-02-10T12:59:59.9", "2024-04-01T05:00:00.0"]


@pytest.mark.parametrize("frequency", ["1h", "7h", "D", "2D", "W", "MS", "ME", "QE", "YS", "90min"])
def test_empty_buckets_are_filled(spark, frequency):
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(TIMES)], "at string, v double")
    out = aggregate_by_time(df, [], {"v": ["count", "sum", "max"]}, "at", frequency, "%Y-%m-%dT%H:%M:%S.%f")
    frame = pd.DataFrame({"at": pd.to_datetime(TIMES, format="%Y-%m-%dT%H:%M:%S.%f"), "v": [float(i) for i in range(5)]})
    want = frame.groupby([pd.Grouper(freq=frequency, key="at")], dropna=False).agg({"v": ["count", "sum", "max"]}).reset_index()
    expected = sorted((a.to_pydatetime(), c, s, None if pd.isna(m) else m) for a, c, s, m in want.itertuples(index=False))
    assert sorted(tuple(r) for r in out.collect()) == expected


def test_bad_time_fails(spark):
    df = spark.createDataFrame([("yesterday", 1)], "at string, v long")
    with pytest.raises(Exception):
        aggregate_by_time(df, [], {"v": ["count"]}, "at", "1h", "%Y").collect()


def test_first_latest_union(spark, table):
    first = {r["host.name"]: r["id"] for r in first_per_key(table, ["host.name"], ["id"]).collect()}
    assert first == {"a": 1, None: 3, "b": 5}
    last = {r["host.name"]: r["id"] for r in latest_per_key(table, ["host.name"], ["id"]).collect()}
    assert last == {"a": 7, None: 4, "b": 5}
    both = union_tagged({"one": table.select("id"), "two": table.select("id", "v")})
    assert both.count() == 14 and both.where("_data_name_ = 'one' AND v IS NULL").count() == 7
    with pytest.raises(ValueError):
        union_tagged([])


def test_more_functions(spark):
    values = [("a", 1.0, True), ("a", 2.0, False), ("a", 4.0, None), ("a", None, True), ("b", 3.0, None), ("c", None, False)]
    df = spark.createDataFrame(values, "k string, v double, f boolean")
    got = {r["k"]: r for r in aggregate(df, ["k"], {"v": ["prod", "sem", "skew"], "f": ["any", "all"]}).collect()}
    known = pd.DataFrame({"k": [r[0] for r in values], "v": [r[1] for r in values]}).groupby("k")["v"].agg(["prod", "sem", "skew"])
    for k, row in known.iterrows():
        for name in ("prod", "sem", "skew"):
            mine = got[k][f"v_{name}"]
            assert (mine is None and pd.isna(row[name])) or abs(mine - row[name]) < 1e-9, (k, name)
    assert {k: (r["f_any"], r["f_all"]) for k, r in got.items()} == {"a": (True, False), "b": (False, True), "c": (False, False)}
