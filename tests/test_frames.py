"""Moving medians, quantiles and distinct counts against frames taken one by one."""

import math
import random

import pytest

from tracewell.operators.frames import Distinct, Frame, Quantile, moving_holistic


def quantile(values, share):
    if not values:
        return None
    values, place = sorted(values), share * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def plain(rows, name_of, frame, fn):
    """fn of the non-null values in the frame of each row; rows are (key, id, time, value)."""
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        for i, row in enumerate(group):
            if frame.by_value:
                inside = [] if row[2] is None else [
                    r for r in group if r[2] is not None
                    and (frame.preceding is None or r[2] >= row[2] - frame.preceding) and (frame.following is None or r[2] <= row[2] + frame.following)
                ]
            else:
                first = 0 if frame.preceding is None else max(0, i - frame.preceding)
                last = len(group) if frame.following is None else max(0, i + frame.following + 1)
                inside = group[first:last]
            out[row[1]] = fn([r[3] for r in inside if r[3] is not None])
    return out


def table_rows(count, seed):
    chance = random.Random(seed)
    times = [None, *range(40)]
    return [(chance.choice(["hot"] * 6 + ["a", None]), i, chance.choice(times), chance.choice([None, 1.5, -2.0, float(chance.randint(0, 60))])) for i in range(count)]


FRAMES = [Frame(3, 2), Frame(None, 0), Frame(None, None), Frame(0, 0), Frame(5, -2), Frame(-1, 4), Frame(2, 3, True), Frame(None, 0, True), Frame(0, None, True)]


@pytest.mark.parametrize(("limit", "frames"), [(None, FRAMES[:1] + FRAMES[6:7]), (60, FRAMES[1:3] + FRAMES[4:6] + FRAMES[7:])])
def test_moving_holistic(spark, limit, frames):
    rows = table_rows(200, 4)
    df = spark.createDataFrame(rows, "k string, id long, t long, v double").repartition(5)
    results = {}
    for n, frame in enumerate(frames):
        results |= {f"m{n}": Quantile("v", frame), f"q{n}": Quantile("v", frame, 0.83), f"d{n}": Distinct("v", frame)}
    got = moving_holistic(df, ["k"], ["t", "id"], results, limit)
    assert got.columns == ["k", "id", "t", "v", *results]
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for n, frame in enumerate(frames):
        median, high = plain(rows, n, frame, lambda v: quantile(v, 0.5)), plain(rows, n, frame, lambda v: quantile(v, 0.83))
        kinds = plain(rows, n, frame, lambda v: len(set(v)))
        for i, r in found.items():
            assert r[f"d{n}"] == kinds[i], (frame, i)
            for name, want in ((f"m{n}", median[i]), (f"q{n}", high[i])):
                assert (r[name] is None) == (want is None) and (want is None or math.isclose(r[name], want, abs_tol=1e-9)), (frame, i)


def test_no_keys_text_values_and_no_rows(spark):
    rows = [(i, "abca"[i % 4] if i % 5 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, s string")
    got = {r["id"]: r["n"] for r in moving_holistic(df, [], ["id"], {"n": Distinct("s", Frame(4, 0))}, 8).collect()}
    assert got == {i: len({s for _, s in rows[max(0, i - 4) : i + 1] if s}) for i in range(50)}
    none = moving_holistic(df.limit(0), [], ["id"], {"n": Distinct("s", Frame(4, 0)), "m": Quantile("id", Frame(None, None))})
    assert none.count() == 0 and none.columns == ["id", "s", "n", "m"]
    nulls = moving_holistic(df.withColumn("v", df["id"].cast("double") * float("nan")).selectExpr("id", "nullif(v, v) AS v"), [], ["id"], {"m": Quantile("v", Frame(3, 3))})
    assert nulls.where("m IS NOT NULL").count() == 0


def long_and_short(spark, kinds):
    rows = [("hot", i, i // 3 if i % 23 else None, None if i % 11 == 4 else float(i * 37 % kinds)) for i in range(150)] + [("b", 1000 + i, i, 1.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, "k string, id long, t long, v double").repartition(3)


def test_rounds_do_not_grow_with_the_values(spark):
    jobs = []
    for kinds in (3, 150):
        spark.sparkContext.setJobGroup(f"frames-{kinds}", "frames")
        moving_holistic(long_and_short(spark, kinds)[1], ["k"], ["t", "id"], {"m": Quantile("v", Frame(90, 30))})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"frames-{kinds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 2, jobs


def test_many_slices_between_the_ends(spark):
    rows, df = long_and_short(spark, 40)
    frames = {"wide": Frame(70, 30), "sofar": Frame(None, 0), "near": Frame(18, 9, True)}
    results = {f"m_{n}": Quantile("v", f, 0.37) for n, f in frames.items()} | {f"d_{n}": Distinct("v", f) for n, f in frames.items()}
    found = {r["id"]: r for r in moving_holistic(df, ["k"], ["t", "id"], results, 11).collect()}
    assert len(found) == len(rows)
    for n, frame in frames.items():
        some, kinds = plain(rows, n, frame, lambda v: quantile(v, 0.37)), plain(rows, n, frame, lambda v: len(set(v)))
        for i, r in found.items():
            assert r[f"d_{n}"] == kinds[i], (n, i)
            assert (r[f"m_{n}"] is None) == (some[i] is None) and (some[i] is None or math.isclose(r[f"m_{n}"], some[i], abs_tol=1e-9)), (n, i)
