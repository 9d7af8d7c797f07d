"""Grouping sets from groups, and chains whose shared steps are stored."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.operators.lattice import cube_sets, grouping_lattice, rollup_sets
from tracewell.plans.steps import Step, plan_key, run_chain, run_chain_reused


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(1)
    return [(chance.choice(["hot"] * 6 + ["a", None]), chance.choice([1, 2, None]), chance.choice("xy"), chance.choice([None, 1.0, 2.5, -3.0])) for _ in range(500)]


def test_lattice(spark, rows):
    df = spark.createDataFrame(rows, "`k.1` string, b int, c string, v double").repartition(4)
    keys = ["k.1", "b", "c"]
    wanted = {"n": ("size", "v"), "held": ("count", "v"), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "m": ("mean", "v")}
    for sets in (cube_sets(keys), rollup_sets(keys), [("k.1", "c"), ("c",)], [("b",), ("b",), ()], [()]):
        groups = defaultdict(list)
        for s in dict.fromkeys(tuple(s) for s in sets):
            bits = sum(1 << (2 - i) for i, k in enumerate(keys) if k not in s)
            for r in rows:
                groups[(*[r[i] if k in s else None for i, k in enumerate(keys)], bits)].append(r[3])
        got = {tuple(r)[:4]: tuple(r)[4:] for r in grouping_lattice(df, keys, sets, wanted).collect()}
        assert got.keys() == groups.keys()
        for key, values in groups.items():
            held = [v for v in values if v is not None]
            want = (len(values), len(held), sum(held) if held else None, min(held, default=None), max(held, default=None), sum(held) / len(held) if held else None)
            assert got[key] == pytest.approx(want)
    assert grouping_lattice(df.limit(0), keys, cube_sets(keys), wanted).count() == 0
    with pytest.raises(ValueError):
        grouping_lattice(df, keys, [()], {"x": ("median", "v")})


def test_lattice_expands_groups_not_rows(spark, rows, capsys):
    df = spark.createDataFrame(rows, "a string, b int, c string, v double")
    grouping_lattice(df, ["a", "b"], cube_sets(["a", "b"]), {"n": ("size", "v")}).explain("simple")
    plan = capsys.readouterr().out
    assert plan.index("Expand") < plan.rindex("HashAggregate") and plan[plan.index("Expand"):].count("HashAggregate") >= 2


def test_shared_steps_are_worked_out_once(spark, rows, folder):
    spark.createDataFrame(rows, "a string, b int, c string, v double").write.parquet(f"{folder}/in")
    spark.range(3).write.parquet(f"{folder}/other")
    worked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(b):
        worked.add(1)
        return b

    def steps(least):
        return [
            Step("seen", lambda r: r["in"].where(F.col("v") > least).select("a", "v", touch.asNondeterministic()("b").alias("b"))),
            Step("sums", lambda r: r["seen"].groupBy("a").agg(F.sum("v").alias("s"))),
            Step("tops", lambda r: r.get("seen").groupBy("a").agg(F.max("b").alias("t"))),
            Step("both", lambda r: r["sums"].withColumnRenamed("a", "x").join(r["tops"], F.col("x").eqNullSafe(F.col("a")))),
        ]

    source = lambda: {"in": spark.read.parquet(f"{folder}/in")}
    plain = sorted(map(str, run_chain(steps(0.0), source())["both"].collect()))
    kept = sum(v is not None and v > 0 for *_, v in rows)
    before = worked.value
    once = run_chain_reused(steps(0.0), f"{folder}/store", source())
    assert sorted(map(str, once["both"].collect())) == plain
    assert worked.value - before == kept
    again = run_chain_reused(steps(0.0), f"{folder}/store", source())["both"]
    assert sorted(map(str, again.collect())) == plain and worked.value - before == kept
    assert all("/store/data-" in f for f in again.inputFiles())
    run_chain_reused(steps(2.0), f"{folder}/store", source())["both"].collect()
    assert worked.value - before == kept + sum(v is not None and v > 2 for *_, v in rows)
    spark.createDataFrame([("new", 9, "x", 7.0)], "a string, b int, c string, v double").write.mode("append").parquet(f"{folder}/in")
    assert run_chain_reused(steps(0.0), f"{folder}/store", source())["both"].where("a = 'new'").count() == 1
    assert plan_key(spark.read.parquet(f"{folder}/other")) != plan_key(spark.read.parquet(f"{folder}/in"))
    with pytest.raises(ValueError):
        run_chain_reused([Step("in", lambda r: r["in"])], f"{folder}/store", source())
