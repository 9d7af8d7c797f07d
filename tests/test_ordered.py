"""Sliced and plain ordered operators against pandas, with hot groups and ties."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators.ordered import (
    RANKS, carry_last, median_values, moving_range, number_rows, plan_slices, rank_rows, rank_values, running_totals,
)
from tracewell.operators.shift import shift


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    out = []
    for i in range(400):
        # One key holds more than half of all rows; some keys are null.
        key = random.choice(["hot"] * 6 + ["a", "b", None])
        out.append((key, i, random.choice([None, 1.0, 2.5, float(random.randint(0, 50))]), random.randint(0, 30)))
    random.shuffle(out)
    return pd.DataFrame(out, columns=["k", "id", "v", "t"])


@pytest.fixture(scope="module")
def table(spark, rows):
    data = [tuple(None if x != x else x for x in r) for r in rows.astype(object).itertuples(index=False)]
    return spark.createDataFrame(data, "k string, id long, v double, t long").repartition(5).persist()


@pytest.mark.parametrize("limit", [10_000, 20, 3])
@pytest.mark.parametrize("periods", [1, 3, -1, -2, 7])
def test_shift(table, rows, limit, periods):
    out = shift(table, ["k"], "v", "s", periods, ["t", "id"], -9.0, rows_per_task=limit)
    assert out.columns == ["k", "id", "v", "t", "s"]
    got = {r["id"]: r["s"] for r in out.collect()}
    ordered = rows.sort_values(["t", "id"])
    want = ordered.groupby("k")["v"].shift(periods, fill_value=-9.0)
    want = dict(zip(ordered["id"], want))
    assert len(got) == len(rows)
    for i, value in want.items():
        assert got[i] == value or (got[i] is None and value != value), i


@pytest.mark.parametrize("periods", [3, 40, -25])
def test_long_shift_of_cut_groups_is_a_join(table, rows, periods, monkeypatch):
    monkeypatch.setattr("tracewell.operators.shift.MANY_ROWS", 2)
    out = shift(table, ["k"], "v", "s", periods, ["t", "id"], -9.0, rows_per_task=20)
    assert out.columns == ["k", "id", "v", "t", "s"]
    got = {r["id"]: r["s"] for r in out.collect()}
    ordered = rows.sort_values(["t", "id"])
    want = dict(zip(ordered["id"], ordered.groupby("k")["v"].shift(periods, fill_value=-9.0)))
    assert len(got) == len(rows)
    for i, value in want.items():
        no_group = rows.loc[rows["id"] == i, "k"].isna().any()
        assert got[i] == (-9.0 if no_group else value) or (got[i] is None and value != value), i


@pytest.mark.parametrize("limit", [10_000, 30])
@pytest.mark.parametrize("periods", [2, -3])
def test_shift_whole_table(table, rows, limit, periods):
    out = shift(table, [], "v", "s", periods, ["t", "id"], 0.0, rows_per_task=limit)
    got = {r["id"]: r["s"] for r in out.collect()}
    ordered = rows.sort_values(["t", "id"])
    want = dict(zip(ordered["id"], ordered["v"].shift(periods, fill_value=0.0)))
    assert {i: got[i] for i in want} == {i: (None if v != v else v) for i, v in want.items()}


def test_shift_text_filler_makes_text(table):
    out = shift(table, ["k"], "t", "s", 1, ["id"], "")
    assert dict(out.dtypes)["s"] == "string"


@pytest.mark.parametrize("limit", [10_000, 25])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(table, rows, limit, descending):
    out = running_totals(table, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, descending, limit)
    got = {r["id"]: (r["s"], r["n"]) for r in out.collect()}
    ordered = rows.sort_values(["t", "id"], ascending=not descending)
    groups = ordered.groupby("k", dropna=False)
    sums = groups["v"].transform(lambda x: x.fillna(0).cumsum())
    counts = groups.cumcount() + 1
    seen = groups["v"].transform(lambda x: x.notna().cumsum())
    for i, s, n, c in zip(ordered["id"], sums, counts, seen):
        assert got[i][1] == n
        assert got[i][0] == (pytest.approx(s) if c else None)


@pytest.mark.parametrize("limit", [10_000, 25])
def test_carry_last(table, rows, limit):
    got = {r["id"]: r["l"] for r in carry_last(table, ["k"], ["t", "id"], {"l": F.col("v")}, limit).collect()}
    ordered = rows.sort_values(["t", "id"])
    want = ordered.groupby("k", dropna=False)["v"].ffill()
    assert got == {i: (None if v != v else v) for i, v in zip(ordered["id"], want)}


@pytest.mark.parametrize("limit", [10_000, 4])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks(table, rows, limit, descending):
    out = rank_values(table.where("v IS NOT NULL"), ["k"], "v", descending, limit)
    got = {(r["k"], r["v"]): (r["rank"], r["dense_rank"], r["percent_rank"]) for r in out.collect()}
    held = rows.dropna(subset=["v"])
    grouped = held.groupby("k", dropna=False)["v"]
    low = grouped.rank("min", ascending=not descending)
    dense = grouped.rank("dense", ascending=not descending)
    size = grouped.transform("size")
    for k, v, a, d, n in zip(held["k"], held["v"], low, dense, size):
        key = (None if k != k or k is None else k, v)
        assert got[key] == (a, d, pytest.approx((a - 1) / (n - 1) if n > 1 else 0.0))


@pytest.mark.parametrize("limit", [10_000, 4])
def test_median_and_row_number(table, rows, limit):
    got = {r["k"]: r["m"] for r in median_values(table, ["k"], "v", "m", limit).collect()}
    want = rows.groupby("k", dropna=False)["v"].median()
    assert got == {(None if k != k else k): v for k, v in want.items()}
    numbered = number_rows(table, ["k"], ["t", "id"], rows_per_task=limit).collect()
    ordered = rows.sort_values(["t", "id"])
    assert {r["id"]: r["row_number"] for r in numbered} == dict(
        zip(ordered["id"], ordered.groupby("k", dropna=False).cumcount() + 1)
    )


@pytest.mark.parametrize("limit", [10_000, 10])
def test_moving_range(spark, table, rows, limit):
    timed = table.withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"))
    out = moving_range(timed, ["k"], "at", 4, {"n": ("count", F.lit(1)), "m": ("max", F.col("id")), "s": ("sum", F.col("v"))}, limit)
    assert out.columns == [*timed.columns, "n", "m", "s"]
    got = {r["id"]: (r["n"], r["m"], r["s"] or 0.0) for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    key = rows["k"].fillna("?")
    for k, i, t in zip(key, rows["id"], rows["t"]):
        frame = rows[(key == k) & (rows["t"] <= t) & (rows["t"] >= t - 4)]
        assert got[i] == (len(frame), frame["id"].max(), pytest.approx(frame["v"].sum()))


def test_slices_only_for_groups_over_the_limit(table):
    assert not plan_slices(table, ["k"], "t", 10_000).split
    assert plan_slices(table, ["k"], "t", 50).split
    with pytest.raises(TypeError):
        plan_slices(table, ["t"], "k", 2)


def test_many_hot_groups_are_joined_not_broadcast(table, rows, monkeypatch):
    from tracewell.operators import ordered

    monkeypatch.setattr(ordered, "FEW_GROUPS", 0)
    slices = plan_slices(table, ["k"], "t", 25)
    counts = rows["k"].value_counts(dropna=False)
    assert slices.split and slices.hot.count() == (counts > 25).sum() == slices.groups
    got = {r["id"]: r["n"] for r in running_totals(table, ["k"], ["t", "id"], {"n": F.lit(1)}, rows_per_task=25).collect()}
    ordered_rows = rows.sort_values(["t", "id"])
    assert got == dict(zip(ordered_rows["id"], ordered_rows.groupby("k", dropna=False).cumcount() + 1))


def test_only_groups_over_the_limit_are_cut(table):
    slices = plan_slices(table, ["k"], "t", 100)
    assert [r["k"] for r in slices.hot.collect()] == ["hot"] and slices.few


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("tiles", [3, 7, 500])
def test_rank_rows_in_both_ways(table, descending, tiles):
    names = ["id", *RANKS, "ntile"]
    plain, cut = (
        sorted(tuple(r) for r in rank_rows(table, ["k"], "t", ["id"], tiles, descending, limit).select(*names).collect())
        for limit in (10_000, 15)
    )
    assert len(plain) == 400 and plain == cut
