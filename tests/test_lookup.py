"""Network lookups and process trees against plain models."""

import ipaddress
import random

import pytest

from tracewell.operators.hierarchy import ProcessColumns, ancestors, descendants, siblings, with_rows
from tracewell.operators.lookup import enrich_assets, in_networks, longest_prefix, resolve_names


@pytest.fixture(scope="module")
def nets():
    random.seed(8)
    out = {"0.0.0.0/0", "10.0.0.0/8", "fd00::/8", "::/0", "10.1.2.3/32"}
    for _ in range(60):
        out.add(str(ipaddress.ip_network((0x0A000000 + random.getrandbits(24), random.randint(9, 32)), strict=False)))
        out.add(str(ipaddress.ip_network(((0xFD << 120) + (random.getrandbits(16) << 104), random.randint(9, 30)), strict=False)))
    return sorted(out) + ["10.0.0.1/8", "bad/8", "10.0.0.0/40"]


def addresses():
    random.seed(18)
    out = [str(ipaddress.ip_address(0x0A000000 + random.getrandbits(24))) for _ in range(150)]
    out += [str(ipaddress.ip_address((0xFD << 120) + (random.getrandbits(16) << 104) + 5)) for _ in range(100)]
    return out + ["10.1.2.3", "11.1.1.1", "::1", "bad", None, "10.1.2.3"]


def valid(net):
    try:
        return ipaddress.ip_network(net)
    except ValueError:
        return None


def test_longest_prefix(spark, nets):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses())], "id int, ip string")
    table = spark.createDataFrame([(n,) for n in nets], "prefix string")
    got = {r["id"]: r["prefix"] for r in longest_prefix(df, "ip", table).collect()}
    for i, a in enumerate(addresses()):
        try:
            address = ipaddress.ip_address(a)
        except ValueError:
            assert i not in got
            continue
        held = [n for n in map(valid, nets) if n is not None and address in n]
        assert got[i] == str(max(held, key=lambda n: n.prefixlen))


def test_allow_list(spark, nets):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses())], "id int, ip string")
    marked = [(n, k % 3 == 0) for k, n in enumerate(nets) if not n.endswith("/0")]
    table = spark.createDataFrame(marked, "network string, allow boolean")
    got = {r["id"] for r in in_networks(df, "ip", table, "network", "allow").collect()}
    allowed = [valid(n) for n, ok in marked if ok and valid(n)]
    want = set()
    for i, a in enumerate(addresses()):
        try:
            if any(ipaddress.ip_address(a) in n for n in allowed):
                want.add(i)
        except ValueError:
            pass
    assert got == want


def test_names_and_assets(spark):
    asked = spark.createDataFrame([("a.example",), ("none.example",)], "name string")
    known = spark.createDataFrame([("a.example", "10.0.0.1"), ("a.example", "10.0.0.2")], "domain string, address string")
    assert resolve_names(asked, "name", known).count() == 2

    targets = spark.createDataFrame([("10.0.0.1",), ("10.0.0.9",)], "ip string")
    listed = spark.createDataFrame(
        [("10.0.0.1", 2, "second", "h2"), ("10.0.0.1", 1, "", "h1")], "address string, ordinal int, description string, hostname string"
    )
    devices = spark.createDataFrame([("h1", 7, "box", {"owner": "ann", "team": "", "env": "prod"})],
                                    "hostname string, device_id long, description string, custom_fields map<string,string>")
    contacts = spark.createDataFrame([(7, "bob"), (7, "ann"), (7, "bob")], "device_id long, contact string")
    nets = spark.createDataFrame([("10.0.0.0/24", ""), ("10.0.0.0/8", "Big NET")], "prefix string, description string")
    row, = enrich_assets(targets, "ip", listed, devices, contacts, nets).collect()
    assert row["hostname"] == "h1" and row["description"] is None and row["description_of_assignment"] == "box"
    assert (row["owner"], row["team"], row["env"]) == ("ann", None, "prod")
    assert row["potential_contacts"] == "ann, bob"
    assert row["description_of_subnet"] == "10.0.0.0/8 (big net) -> 10.0.0.0/24 (no info)"
    assert "potential_contacts" not in enrich_assets(targets, "ip", listed, devices, contacts, nets, fast=True).columns


NAMES = ProcessColumns("pid", "ppid", "at", "id")


@pytest.fixture(scope="module")
def forest():
    """Few pids, so that every pid is used many times."""
    random.seed(2)
    return [(i, random.randint(0, 8), random.randint(0, 8), random.randint(0, 50)) for i in range(80)]


@pytest.mark.parametrize("limit", [10_000, 5])
@pytest.mark.parametrize("gte", [None, 10])
def test_ancestors(spark, forest, limit, gte):
    df = spark.createDataFrame(forest, "id long, pid long, ppid long, at long")
    seeds = df.where("id < 20").selectExpr("*", "id AS seed_id")
    got = sorted(tuple(r) for r in ancestors(df, seeds, 3, NAMES, gte, limit).collect())
    want = []
    for seed in forest[:20]:
        want.append((seed[0], seed[0], 0))
        last = seed
        for step in (1, 2, 3):
            held = [p for p in forest if p[1] == last[2] and p[3] <= last[3] and (gte is None or p[3] >= gte)]
            if not held:
                break
            last = max(held, key=lambda p: (p[3], p[0]))
            want.append((seed[0], last[0], -step))
    assert got == sorted(want)


def test_descendants(spark, forest):
    df = spark.createDataFrame(forest, "id long, pid long, ppid long, at long")
    seeds = df.where("id < 6").selectExpr("*", "id % 3 AS seed_id")
    got = sorted(tuple(r) for r in descendants(df, seeds, 3, NAMES, 40).collect())
    want = []
    for seed_id in range(3):
        rows = sorted((p for p in forest[:6] if p[0] % 3 == seed_id), key=lambda p: (p[3], p[0]), reverse=True)
        want += [(seed_id, p[0], 0) for p in rows]
        frontier, done = [(rows[0][1], rows[0][3])], set()
        for step in (1, 2, 3):
            ahead = []
            for pid, at in frontier:
                if (pid, at) in done:
                    continue
                done.add((pid, at))
                for p in forest:
                    if p[2] == pid and at <= p[3] <= 40:
                        want.append((seed_id, p[0], step))
                        ahead.append((p[1], p[3]))
            frontier = ahead
    assert got == sorted(want)


def test_siblings(spark, forest):
    df = spark.createDataFrame(forest, "id long, pid long, ppid long, at long")
    seed = forest[3]
    found = siblings(df, df.where("id = 3").selectExpr("*", "1 AS seed_id"), NAMES, 5, 45)
    got = sorted((r["row_id"], r["is_seed"]) for r in found.collect())
    assert got == sorted([(3, True)] + [(p[0], False) for p in forest if p[2] == seed[2] and 5 <= p[3] <= 45])
    assert with_rows(found, df, NAMES).columns == ["family", "is_seed", "id", "pid", "ppid", "at"]
