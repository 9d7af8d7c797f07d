"""Dynamic aggregation against a plain row-by-row model."""

import random

import pytest

from tracewell.operators import dynamic
from tracewell.operators.dynamic import assign_seeds, dynamic_aggregate


def model(rows, fields):
    """rows: list of (values tuple, n) in group order; returns the final layer's input."""
    while True:
        taken, out = [False] * len(rows), []
        for i, (values, _) in enumerate(rows):
            if taken[i]:
                continue
            lines = []
            for f in range(fields):
                lines.append([j for j, (other, _) in enumerate(rows) if not taken[j]
                              and all(other[g] == values[g] for g in range(fields) if g != f)])
            best = max(range(fields), key=lambda f: len(lines[f]))
            merged = list(values)
            merged[best] = ",".join(sorted({rows[j][0][best] for j in lines[best]}))
            out.append((tuple(merged), sum(rows[j][1] for j in lines[best])))
            for j in lines[best]:
                taken[j] = True
        if len(out) >= len(rows):
            return rows
        rows = out


@pytest.mark.parametrize("limit,seed,size", [(10_000, 1, 60), (10_000, 2, 25), (4, 3, 14), (4, 4, 18), (1, 5, 10)])
def test_against_model(spark, limit, seed, size):
    random.seed(seed)
    values = [["a", "b", "c", None], ["x", "y", "z"], ["1", "2", "3", "4"]]
    data = [tuple(random.choice(v) for v in values) + (random.choice(["p", "q"]),) for _ in range(size)]
    df = spark.createDataFrame(data, "h string, r string, c string, extra string")
    out = dynamic_aggregate(df, ["h", "r", "c", "extra"], {"extra": ["count"]}, ["h", "r", "c"], {"extra_count": "sum"}, component_rows=limit)
    got = sorted((r["h"], r["r"], r["c"], r["extra_count"]) for r in out.collect())
    assert all(r["aggregated"] for r in out.collect())

    counts = {}
    for row in data:
        counts[row] = counts.get(row, 0) + 1
    ordered = sorted(counts, key=lambda row: tuple((v is None, v or "") for v in row))
    rows = [(tuple("-" if v is None else v for v in row[:3]), counts[row]) for row in ordered]
    assert got == sorted((*values, n) for values, n in model(rows, 3))
    assert sum(r[3] for r in got) == size


def test_many_small_components_and_a_large_one(spark):
    """Batches of components in tasks, and rounds for the one over the limit, in one layer."""
    random.seed(11)
    data = [(f"h{random.randint(0, 9)}", f"r{random.randint(0, 9)}", f"c{random.randint(0, 9)}") for _ in range(40)]
    data += [("big", f"r{i % 3}", f"x{i}") for i in range(15)]
    data = sorted(set(data))
    df = spark.createDataFrame([(*row, 1) for row in data], "h string, r string, c string, n int")
    out = dynamic_aggregate(df, ["h", "r", "c"], {"n": ["count"]}, ["h", "r", "c"], {"n_count": "sum"}, component_rows=9)
    got = sorted((r["h"], r["r"], r["c"], r["n_count"]) for r in out.collect())
    assert got == sorted((*values, n) for values, n in model([(row, 1) for row in data], 3))


def test_specs_that_rename_run_over_layers(spark):
    data = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4)]
    df = spark.createDataFrame(data, "h string, r string, v int")
    out = dynamic_aggregate(df, ["h", "r"], {"v": ["sum"]}, ["h", "r"], {"v_sum": ["min", "sum"]})
    assert [tuple(r) for r in out.collect()] == [("a,b", "x,y", 1, 10, True)]
    with pytest.raises(ValueError):
        dynamic_aggregate(df, ["h", "r"], {"v": ["sum"]}, ["h", "r"], {"v_sum": "median"})


def plain_pass(rows):
    """(id, seed, field) of the greedy pass over (id, key, ...) rows in id order."""
    left, out = dict((r[0], r[1:]) for r in rows), []
    for number, *values in sorted(rows):
        if number not in left:
            continue
        fields = range(len(values))
        lines = [[o for o, other in left.items() if all(other[g] == values[g] for g in fields if g != f)] for f in fields]
        best = max(fields, key=lambda f: len(lines[f]))
        out += [(o, number, best) for o in lines[best]]
        for o in lines[best]:
            del left[o]
    return sorted(out)


def scattered(sides, n):
    random.seed(23)
    return sorted({tuple(random.randrange(side) for side in sides) for _ in range(n)})


@pytest.mark.parametrize("values,blocks,most_rounds", [
    (scattered((60, 25), 900), 6, 8),  # dense: the former way took a round a row that acts
    (scattered((12, 12, 12), 700), 5, 16),
    ([(i // 2, (i + 1) // 2) for i in range(600)], 6, 9),  # a chain through all rows
    ([(0, i) for i in range(500)], 5, 5),  # one line holds all rows
])
def test_blocks_of_one_component(spark, monkeypatch, values, blocks, most_rounds):
    rounds, one = [], dynamic.solve_round
    monkeypatch.setattr(dynamic, "solve_round", lambda state: rounds.append(1) or one(state))
    data = [(3 * i + 2, *map(str, v)) for i, v in enumerate(values)]
    keys = [f"k{i}" for i in range(len(values[0]))]
    df = spark.createDataFrame(data, "__id long, " + ", ".join(f"{k} string" for k in keys))
    got = sorted(map(tuple, assign_seeds(df, keys, len(data), len(data) // blocks).collect()))
    assert got == plain_pass(data)
    assert 1 < len(rounds) <= most_rounds


def test_no_rows_and_one_layer(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4)], "h string, r string, v int")
    args = (["h", "r"], {"v": ["sum"]}, ["h", "r"], {"v_sum": "sum"})
    assert dynamic_aggregate(df.where("false"), *args).count() == 0
    got = sorted(tuple(r) for r in dynamic_aggregate(df, *args, layers=1).collect())
    assert got == [("a,b", "x", 4, True), ("a,b", "y", 6, True)]
