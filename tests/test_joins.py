"""As-of, range and apply joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.apply import Bind, apply_equal, apply_within, bind_parameters
from tracewell.operators.ranges import asof_join, overlap_join, range_join


@pytest.fixture(scope="module")
def two(spark):
    random.seed(9)
    left = [(random.choice(["h", "h", "h", "x", None]), i, random.randint(0, 60)) for i in range(150)]
    right = [(random.choice(["h", "h", "h", "x", None]), i, random.randint(0, 60)) for i in range(120)]
    return (left, right, spark.createDataFrame(left, "k string, id long, t long").repartition(4),
            spark.createDataFrame(right, "k string, rid long, rt long").repartition(4))


@pytest.mark.parametrize("limit", [10_000, 12])
def test_asof(two, limit):
    left, right, l, r = two
    out = asof_join(l, r, ["k"], "t", "rt", ["rid", "rt"], "rid", limit).collect()
    got = {x["id"]: x["rid"] for x in out}
    assert len(out) == len(left)
    for k, i, t in left:
        held = [(rt, rid) for rk, rid, rt in right if rk == k and k is not None and rt <= t]
        assert got[i] == (max(held)[1] if held else None)


@pytest.mark.parametrize("width", [1.0, 5.0, 100.0])
def test_range_join(two, width):
    left, right, l, r = two
    rr = r.withColumnRenamed("k", "rk")
    out = range_join(l, rr, [("k", "rk")], F.col("t") - 3, F.col("t") + 2, "rt", width)
    got = sorted((x["id"], x["rid"]) for x in out.collect())
    want = sorted((i, rid) for k, i, t in left for rk, rid, rt in right if k is not None and k == rk and t - 3 <= rt <= t + 2)
    assert got == want


def test_apply_patterns_and_copies(spark):
    target = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "host string, n long")
    binds = [Bind("host", "q", "host='%(__pattern_value__)s' in %(__pattern_data__)s.%(__pattern_column__)s as %(__pattern_as__)s 100%%")]
    got = [r["applied_q"] for r in bind_parameters(target, binds, "alerts").collect()]
    assert got == ["host='a' in alerts.host as q 100%"] * 2 + ["host='None' in alerts.host as q 100%"]
    with pytest.raises(ValueError):
        bind_parameters(target, [Bind("missing", "m")])
    source = spark.createDataFrame([("a", 5), ("b", 6)], "h string, v long")
    bound = bind_parameters(target, [Bind("host", "host"), Bind("n", "n")])
    found = apply_equal(bound, source, {"applied_host": "h"}).collect()
    assert [(r["v"], r["applied_n"]) for r in found] == [(5, 1), (5, 1)]
    assert apply_equal(bound.where("false"), source, {"applied_host": "h"}).count() == 0


def test_apply_within_keeps_both_bounds(spark):
    events = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts, 'u' AS u FROM range(30)")
    bound = bind_parameters(events.where("id = 15"), [Bind("u", "user"), Bind("ts", "at")])
    got = apply_within(bound, events, {"applied_user": "u"}, "applied_at", "ts", 5, 2)
    assert sorted(r["id"] for r in got.collect()) == list(range(10, 18))


def spread(seed, rows, prefix):
    """Ranges of all lengths, points, open and missing ends, ends before starts, repeats, and one hot key."""
    chance = random.Random(seed)
    out = []
    for i in range(rows):
        start = chance.choice([chance.randint(-3000, 3000) / 2, chance.randint(0, 20) * 16.0])
        length = chance.choice([0, 1, 16, 17, chance.randint(0, 50), chance.randint(0, 100_000), -3])
        end = chance.choice([start + length] * 8 + [None, float("inf")])
        out.append((chance.choice(["hot"] * 4 + ["a", None]), i, chance.choice([start] * 9 + [None, float("-inf")]), end))
    return [*out, *out[:5]]


@pytest.mark.parametrize("width", [1.0, 16.0, 5000.0])
def test_overlap_join(spark, width):
    left, right = spread(3, 120, "l"), spread(4, 90, "r")
    a = spark.createDataFrame(left, "k string, id long, s double, e double").repartition(3)
    b = spark.createDataFrame(right, "rk string, rid long, rs double, re double").repartition(3)
    found = overlap_join(a, b, [("k", "rk")], (F.col("s"), F.col("e")), (F.col("rs"), F.col("re")), width)
    got = sorted((r["id"], r["rid"]) for r in found.collect())
    whole = lambda rows: [r for r in rows if None not in r and r[2] <= r[3]]
    want = sorted((i, j) for k, i, s, e in whole(left) for q, j, t, f in whole(right) if k == q and s <= f and t <= e)
    assert got == want and len(want) > 1000
    assert found.columns == ["k", "id", "s", "e", "rk", "rid", "rs", "re"]
    points = b.withColumn("p", F.col("rs"))
    inside = sorted((r["id"], r["rid"]) for r in range_join(a, points, [("k", "rk")], F.col("s"), F.col("e"), "p", width).collect())
    assert inside == sorted((i, j) for k, i, s, e in whole(left) for q, j, t, _ in right if k == q and t is not None and s <= t <= e)
    none = overlap_join(a.limit(0), b, [("k", "rk")], (F.col("s"), F.col("e")), (F.col("rs"), F.col("re")), width)
    assert none.count() == 0


def test_long_ranges_have_few_copies(spark):
    """A range of a million cells meets a point a cell; neither is copied to every cell."""
    ranges = spark.range(3).selectExpr("id", "0D AS s", "1e6D * id AS e")
    points = spark.range(0, 2_000_000, 1000).selectExpr("id AS rid", "CAST(id AS DOUBLE) AS p")
    out = range_join(ranges, points, [], F.col("s"), F.col("e"), "p", 1.0)
    assert out.count() == 1 + 1001 + 2000
    from tracewell.operators.ranges import _NODES

    copies = spark.sql(f"SELECT size({_NODES}) AS n FROM (SELECT -77L AS __first, 999999999L AS __last)").first()["n"]
    assert copies <= 30 * 8
