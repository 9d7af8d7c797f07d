"""Samples, deep pages and stored sketches against plain Python."""

import datetime as dt
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.operators import paging
from tracewell.operators.paging import deep_page
from tracewell.operators.sampling import sample_rows, sample_strata
from tracewell.operators.sketches import SketchTable, build_sketches, estimates, roll_up


def chance_of(seed, *key):
    return hashlib.md5("|".join([str(seed), *(str(k) for k in key if k is not None)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(6)
    return [(i, chance.choice(["hot"] * 8 + ["a", "b", None]), chance.choice([None, 1.5, -2.0, float("nan"), float(chance.randint(0, 9))])) for i in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, s string, v double").repartition(7)


@pytest.mark.parametrize("limit", [None, 100])
def test_samples(table, rows, limit):
    order = sorted(rows, key=lambda r: chance_of(3, r[0]))
    for size in (0, 1, 700, 5000):
        got = {r.id for r in sample_rows(table, size, ["id"], 3, limit).collect()}
        assert got == {r[0] for r in order[:size]}
    again = {r.id for r in sample_rows(table.repartition(3, "s"), 700, ["id"], 3).collect()}
    assert again == {r[0] for r in order[:700]}
    groups = defaultdict(list)
    for r in order:
        groups[r[1]].append(r[0])
    got = Counter((r.s, r.id) for r in sample_strata(table, ["s"], 40, ["id"], 3, limit).collect())
    assert got == Counter((s, i) for s, ids in groups.items() for i in ids[:40])
    got = Counter((r.s, r.id) for r in sample_strata(table, ["s"], 0.07, ["id"], 3, limit).collect())
    assert got == Counter((s, i) for s, ids in groups.items() for i in ids[: math.ceil(0.07 * len(ids))])


def test_samples_of_equal_keys_and_of_nothing(table):
    assert sample_rows(table.limit(0), 5, ["id"]).count() == 0 and sample_strata(table.limit(0), ["s"], 5, ["id"]).count() == 0
    assert sample_rows(table, 123, ["s"], 1).count() == 123  # few keys: their rows are told apart by the rest
    twice = table.unionByName(table)
    assert sample_rows(twice, 4001, ["id"], 1).count() == 4001
    with pytest.raises(ValueError):
        sample_rows(table, -1, ["id"])
    nested = table.withColumn("m", F.create_map("s", "id")).where("s IS NOT NULL")
    assert sample_rows(nested, 5, ["id"], 2).columns == ["id", "s", "v", "m"]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("few", [50, 10_000])
def test_deep_pages(table, rows, descending, few):
    def place(r):  # nulls are smallest, NaN is largest
        return (r[2] is not None, (r[2] != r[2], r[2] if r[2] == r[2] else 0) if r[2] is not None else (False, 0), r[0])

    listed = [r[0] for r in sorted(rows, key=place, reverse=descending)]
    for offset, size in [(0, 10), (1490, 25), (2995, 50), (3000, 5), (700, 1)]:
        got = [r.id for r in deep_page(table, ["v", "id"], size, offset, descending, few).collect()]
        assert got == listed[offset : offset + size]


def test_deep_pages_of_ties_share_and_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(paging, "PIVOTS", 5)
    rows = [(1, "same")] * 900 + [(1, f"r{i}") for i in range(50)] + [(2, f"r{i}") for i in range(60)] + [(None, "x")]
    table = spark.createDataFrame(rows, "k int, t string").repartition(4)
    pages = [deep_page(table, ["k"], 97, at, few=20).collect() for at in range(0, 1100, 97)]
    assert [len(p) for p in pages][:10] == [97] * 10
    assert Counter(tuple(r) for p in pages for r in p) == Counter(rows)
    assert deep_page(table.limit(0), ["k"], 5).count() == 0


def test_few_passes_find_a_cut(spark):
    listed = spark.range(200_000).withColumn("__o", F.struct(F.col("id").alias("f0"), F.xxhash64("id").alias("tie")))
    found = paging._List(listed, False, 200_000, 500)
    row, before = found.cut(123_456)
    assert row["f0"] == 123_456 and before == 123_456 and found.passes <= 6


def test_sketches(spark, tmp_path):
    chance = random.Random(2)
    begin = dt.datetime(2024, 3, 1)
    data = [
        (i, chance.choice(["hot"] * 5 + ["a", None]), begin + dt.timedelta(minutes=7 * i) if i % 50 else None, chance.choice([None, chance.randint(0, 900)]), chance.choice([None, float("nan"), chance.gauss(0, 1)]))
        for i in range(4000)
    ]
    df = spark.createDataFrame(data, "id long, k string, t timestamp_ntz, u int, v double").repartition(5)
    stored = SketchTable(spark, f"{tmp_path}/sketches", ["k"], "t")
    for part in range(3):
        stored.append(build_sketches(df.where(F.col("id") % 3 == part), ["k"], "t", "1h", ["u"], ["v"]))
    assert stored.read().count() == df.select("k", F.date_trunc("hour", "t")).distinct().count()
    whole = {(r.k, r.t): r for r in estimates(build_sketches(df, ["k"], "t", "D", ["u"], ["v"]), [0.5]).collect()}
    days = {(r.k, r.t): r for r in estimates(stored.read("D"), [0.1, 0.5]).collect()}
    assert days.keys() == whole.keys() and all(days[k].about_u == whole[k].about_u and days[k].rows == whole[k].rows for k in days)
    values, users, count = defaultdict(list), defaultdict(set), Counter()
    for _, k, _, u, v in data:
        count[k] += 1
        users[k] |= {u} - {None}
        values[k] += [v] if v is not None and v == v else []
    for r in estimates(roll_up(stored.read(), ["k"]), [0.1, 0.5, 0.9]).collect():
        assert r.rows == count[r.k] and abs(r.about_u - len(users[r.k])) <= 0.07 * len(users[r.k])
        for share, at in zip((0.1, 0.5, 0.9), r.v_at):
            assert abs(sum(v <= at for v in values[r.k]) / len(values[r.k]) - share) < 0.04
    nothing = build_sketches(df.where("v IS NULL AND u IS NULL"), [], "t", "D", ["u"], ["v"])
    assert {(r.about_u, r.v_at) for r in estimates(nothing).collect()} == {(0, None)}
    assert build_sketches(df.limit(0), ["k"], "t", "D", ["u"]).count() == 0
    with pytest.raises(ValueError):
        build_sketches(df, ["k"], "t", "7h")
