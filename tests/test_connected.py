"""Connected components against a plain search."""

import random

import pytest

from tracewell.operators.connected import connected


def plain(links):
    next_to = {}
    for a, b in links:
        next_to.setdefault(a, set()).add(b)
        next_to.setdefault(b, set()).add(a)
    root = {}
    for node in sorted(next_to):
        found = [] if node in root else [node]
        while found:
            at = found.pop()
            if at not in root:
                root[at] = node
                found += next_to[at]
    return root


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(5, 5), (5, 5)],
        [(3, 3), (1, 2), (2, 1), (1, 2), (-4, 2), (2**62, -(2**62))],
        [(k, k + 1) for k in range(60)],  # a chain
        [(1000, k) for k in range(200)] + [(1001, k) for k in range(200, 300)],  # hot nodes above all their neighbours
        [(0, k) for k in range(1, 200)],
    ],
)
def test_shapes(spark, links):
    assert {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()} == plain(links)


def test_random_links_and_nulls(spark):
    chance = random.Random(4)
    links = [(chance.randrange(400), chance.randrange(400)) for _ in range(230)]
    table = spark.createDataFrame([*links, (None, 1), (2, None), (None, None)], "a long, b long")
    got = connected(table).collect()
    assert len(got) == len(plain(links)) and {r.node: r.root for r in got} == plain(links)
