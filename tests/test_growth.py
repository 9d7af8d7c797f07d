"""What must not grow with the table: plans, rows that move, state that travels with them."""

import random
import re

from pyspark.sql import functions as F

from tracewell.columns import attach
from tracewell.operators import connected, ranges
from tracewell.operators.ordered import SLICE, Slices, add_slices
from tracewell.plans.catalogue import all_queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_slices_are_found_by_a_search_that_is_short_in_the_plan(spark):
    random.seed(2)
    bounds = tuple(sorted({random.randrange(100_000) / 4 for _ in range(4_000)}))
    values = [None, float("nan"), float("inf"), float("-inf"), -1.0, bounds[0], bounds[-1], *random.sample(bounds, 200), *[random.randrange(100_000) / 3 for _ in range(200)]]
    for cuts in (bounds, bounds[:1], bounds[:2], bounds[:3], bounds[:255], bounds[:256]):
        sliced = add_slices(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", Slices(cuts))
        for v, place in sliced.select("v", SLICE).collect():
            assert place == (-1 if v is None else sum(v >= b or v != v for b in cuts))
    assert len(plan_of(add_slices(spark.range(1), [], "id", Slices(bounds)).limit(1)).split("CASE WHEN")) < 50


def test_limits_of_few_strata_come_to_the_rows(spark, monkeypatch):
    from tracewell.operators import sampling

    asked = []
    monkeypatch.setattr(sampling, "attach", lambda *a, **k: (asked.append(k.get("small")), attach(*a, **k))[1])
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    assert sampling.sample_strata(rows, ["s"], 10, ["id"], 1).groupBy("s").count().select("count").distinct().first()[0] == 10
    assert asked == [True]


def test_sketches_do_not_travel_with_distinct_values(spark, tmp_path):
    rows = spark.range(2_100).selectExpr("id % 700 AS l_partkey", "elt(1 + id % 3, 'A', 'N', 'R') AS l_returnflag", "CAST(id AS double) AS l_extendedprice")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = all_queries()["sql_approx"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(f, 700, True, True, True) for f in "ANR"}
    assert not re.search(r"keys=\[[^\]]*l_partkey[^\]]*\], functions=\[[^\n]*percentile_approx", plan_of(found))


def test_usual_keys_of_overlaps_are_joined_as_they_are(spark, monkeypatch):
    random.seed(4)
    spans = lambda keys, n: [(i, random.choice(keys), a, a + random.randrange(-1, 90)) for i in range(n) for a in [random.randrange(500)]]
    monkeypatch.setattr(ranges, "FEW_RANGES", 6)
    for stabs, keys in ((0, [*range(60), None]), (2, [*range(60), *[7] * 30, None])):
        left, right = spans(keys, 150), [*spans(keys, 150), (999, 3, None, 5)]
        used = []
        stab = ranges._stab
        monkeypatch.setattr(ranges, "_stab", lambda *a, **k: (used.append(1), stab(*a, **k))[1])
        lefts, rights = spark.createDataFrame(left, "i int, k int, a int, b int"), spark.createDataFrame(right, "j int, l int, c int, d int")
        found = ranges.overlap_join(lefts, rights, [("k", "l")], (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), 16.0)
        wanted = [(i, j) for i, k, a, b in left for j, l, c, d in right if k is not None and k == l and c is not None and a <= b and c <= d and c <= b and a <= d]
        assert sorted((r.i, r.j) for r in found.collect()) == sorted(wanted) and wanted
        assert len(used) == stabs
        monkeypatch.setattr(ranges, "_stab", stab)


def test_rows_of_one_node_are_not_dealt_to_one_task(spark, monkeypatch):
    random.seed(6)
    links = [(0, i) for i in range(1, 200)] + [(500 + random.randrange(40), 500 + random.randrange(40)) for _ in range(30)] + [(900, 900), (None, 3)]
    left: dict[int, int] = {}
    root = lambda x: x if left.setdefault(x, x) == x else root(left[x])
    for a, b in links[:-1]:
        low, high = sorted((root(a), root(b)))
        left[high] = low
    table = spark.createDataFrame(links, "a long, b long")
    told, plans = connected._told, []
    monkeypatch.setattr(connected, "_told", lambda *a: (plans.append(told(*a)), plans[-1])[1])
    for hot in (5, 100_000):
        assert {r.node: r.root for r in connected.connected(table, hot).collect()} == {x: root(x) for x in left}
    assert all("Broadcast" in plan_of(p) for p in plans)
