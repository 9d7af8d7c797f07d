"""Roots and subtree labels against a walk through the tree."""

import random

import pytest

from tracewell.operators.hierarchy import ProcessColumns, forest, roots, subtree_labels

NAMES = ProcessColumns("pid", "ppid", "at", "id")
SCHEMA = "id long, pid long, ppid long, at int, v double, row_id string, up int"


def rows():
    chance = random.Random(12)
    chain = [(i, i, i - 1, i // 3, 1.0) for i in range(1, 131)]  # deep, with equal times
    star = [(1000 + i, 1000 + i, 5, 400, float(i)) for i in range(100)]  # one parent of many
    reused = [(2000 + i, chance.randint(5000, 5010), chance.choice([None, *range(5000, 5012)]), chance.choice([None, *range(30)]), chance.choice([None, 2.0])) for i in range(80)]
    odd = [(3000, None, 5, 500, 1.0), (3001, 3001, 3001, 500, 1.0), (3002, 3003, 3004, 7, 1.0), (3003, 3004, 3003, 7, 1.0), (3004, 77_777, 99_999, 1, None)]
    again = [(120, 120, 119, 40, 1.0), (120, 120, 3, 90, 9.0), (None, 4, 3, 2, 1.0)]
    return [(*r, "x", 1) for r in [*chain, *star, *reused, *odd, *again]]


def plain():
    first = {}
    for i, pid, ppid, at, v, *_ in sorted((r for r in rows() if r[0] is not None), key=lambda r: (r[3] is not None, r[3] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        first.setdefault(i, (pid, ppid, at, v))
    parent = {}
    for i, (_, ppid, at, _) in first.items():
        before = [(t, j) for j, (pid, _, t, _) in first.items() if pid == ppid and pid is not None and t is not None and at is not None and (t, j) < (at, i)]
        parent[i] = max(before)[1] if before else None
    return first, parent


@pytest.mark.parametrize("limit", [None, 40])
def test_roots_and_labels(spark, limit):
    first, parent = plain()
    table = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert {r.row_id: r.parent_id for r in forest(table, NAMES, limit).collect()} == parent

    def path(i):
        return [i] if parent[i] is None else [*path(parent[i]), i]

    paths = {i: path(i) for i in first}
    if limit:  # cut groups: the rest does not depend on it but for the siblings' order
        assert {(r.row_id, r.size) for r in subtree_labels(table, None, NAMES, limit).collect()} == {(i, sum(i in p for p in paths.values())) for i in first}
        return
    found = {r.row_id: r for r in subtree_labels(table, "v", NAMES).collect()}
    assert {r.row_id: (r.root_id, r.depth) for r in roots(table, NAMES).collect()} == {i: (p[0], len(p) - 1) for i, p in paths.items()}
    assert max(len(p) for p in paths.values()) > 100
    place = {i: tuple((first[j][2] is not None, first[j][2] or 0, j) for j in p) for i, p in paths.items()}
    for i, r in found.items():
        below = [j for j, p in paths.items() if i in p]
        values = [first[j][3] for j in below if first[j][3] is not None]
        same = sorted((j for j, p in paths.items() if p[0] == paths[i][0]), key=lambda j: place[j])
        assert (r.root_id, r.depth, r.enter, r.size) == (paths[i][0], len(paths[i]) - 1, same.index(i), len(below))
        assert r.leave == r.enter + len(below) - 1 and (r.total == pytest.approx(sum(values)) if values else r.total is None)
        assert {j for j, q in found.items() if q.root_id == r.root_id and r.enter <= q.enter <= r.leave} == set(below)
    assert len(found) == len(first)


def test_no_processes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert roots(none, NAMES).count() == 0 and subtree_labels(none, None, NAMES).count() == 0
    one = spark.createDataFrame([(1, 1, 1, 0, None, "x", 1)], SCHEMA)
    assert [tuple(r) for r in subtree_labels(one, None, NAMES).collect()] == [(1, 1, 0, 0, 0, 1, None)]
