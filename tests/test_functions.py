"""Scalar functions against the Python standard library."""

import datetime
import ipaddress
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions.network import ip_bits, ip_is_private, ip_port2ip, validate_ip_address
from tracewell.functions.register import pattern_first, register_functions
from tracewell.functions.text import bytes_to_string, regexp_find_all, regexp_search, regexp_substr
from tracewell.functions.times import (
    datetime_to_timestamp, local_to_epoch_millis, shift_seconds, spark_pattern, unixtime_to_iso_timestamp,
)

EDGES = [
    None, "", "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
    "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":1", "1:", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::1.2.3.4",
    "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "2001:1::1", "2001:1::3",
    "2001:20::5", "12345::", "g::1", "::01.2.3.4", "192.0.0.9", "192.0.0.8", "192.0.0.170", "100.64.0.1", " 1.2.3.4",
    "1.2.3.4:80", "::1/64", "1:2:3:4:5:6:7", "FC00::A", "255.255.255.255", "64:ff9b:1::1", "100::1",
]


@pytest.fixture(scope="module")
def ips(spark):
    random.seed(3)
    values = list(EDGES)
    for _ in range(400):
        values.append(str(ipaddress.ip_address(random.getrandbits(32))))
        values.append(str(ipaddress.ip_address(random.getrandbits(128))))
        top = random.choice([0, 0xFC00, 0xFE80, 0x2001, 0x2002, 0x0064]) << 112
        values.append(str(ipaddress.ip_address(top + random.getrandbits(random.choice([8, 32, 48, 110])))))
        values.append("".join(random.choice("0123:::.fag%") for _ in range(random.randint(1, 12))))
    return spark.createDataFrame([(v,) for v in values], "ip string")


def test_addresses(ips):
    rows = ips.select("ip", validate_ip_address("ip").alias("v"), ip_is_private("ip").alias("p"), ip_bits("ip").alias("b")).collect()
    for r in rows:
        try:
            address = ipaddress.ip_address(str(r.ip))
        except ValueError:
            assert (r.v, r.p, r.b) == (False, False, None), r.ip
            continue
        bits = format(int(address), "032b" if address.version == 4 else "0128b")
        assert (r.v, r.p, r.b) == (True, address.is_private, f"{address.version}{bits}"), r.ip


def test_ip_port(spark):
    df = spark.createDataFrame([("1.2.3.4:80",), ("1.2.3.4",), ("",), (None,), (":80",)], "s string")
    assert [r[0] for r in df.select(ip_port2ip("s")).collect()] == ["1.2.3.4", "1.2.3.4", "", "ip_port2ip_error", ""]
    compat = [r[0] for r in df.select(ip_port2ip("s", compat=True)).collect()]
    assert compat == ["1.2.3.4", "1.2.3.", "", "ip_port2ip_error", ""]


TEXTS = ["it's a\\b \"q\"\n'x'", "user=bob,user=al", "", "no", "tab\there"]


@pytest.mark.parametrize("pattern", [r"\w+", r"user=(\w+)", r"(us)er=(\w+)", r"[^ ]+", r"z", r"(?:a|b)+"])
def test_patterns(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = df.select("t", regexp_search(pattern, "t").alias("s"), regexp_substr(pattern, "t").alias("l"), regexp_find_all(pattern, "t").alias("a"))
    for r in out.collect():
        found = re.findall(pattern, r.t)
        assert r.s == (re.search(pattern, r.t) is not None)
        assert r.l == str(found)
        assert r.a == [f[0] if isinstance(f, tuple) else f for f in found]
    assert df.limit(1).select(regexp_substr(pattern, "cast(null AS string)")).first()[0] == "regexp_error"


ODD_TEXTS = [*TEXTS, "Zoë ٣٤ naïve\u00a0x\u2028y\u0301_1", "a\r\nb\n", "x\x85y\x00z\u200b\U000e0001", "['a&&b']", "aab  ba", "日本語 12 \U0001f600y"]


@pytest.mark.parametrize("pattern", [
    r"\w+", r"\d+", r"\s", r"\S+", r"\W", r"\b\w", r"[\w&]+", r"[^\s\w]", r"[&^[]+", r"a*", r".+", r"b$", r"^.", r"(a)|(b)", r"(?P<x>a)(?:b|a)(?=b)", r"a{1,2}",
    r"", r"x*?(?=y)", r"\b", r"it's", r"\[.\]", r"[a\]-]", r"(\w)(\w)(\w)", r"x?y",
])
def test_literal_patterns_are_native_and_the_same(spark, pattern):
    register_functions(spark)
    spark.createDataFrame([(t,) for t in [*ODD_TEXTS, None]], "t string").createOrReplaceTempView("odd_texts")
    literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
    out = spark.sql(pattern_first(f"SELECT t, regexp('{literal}', t) AS s, regexp_substr( '{literal}' , t) AS l FROM odd_texts"))
    assert "ython" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        if r.t is None:
            assert (r.s, r.l) == (None, "regexp_error")
        else:
            assert (r.s, r.l) == (re.search(pattern, r.t) is not None, str(re.findall(pattern, r.t)))
    raw = spark.sql(pattern_first(f'SELECT t, regexp_substr(r\'{pattern}\', t) AS l FROM odd_texts')) if "'" not in pattern else out
    assert sorted(r.l for r in raw.collect()) == sorted(r.l for r in out.collect())


@pytest.mark.parametrize("pattern", [r"(?i)ZO", r"(?<=a)b", r"(a)\1", r"[\W]", r"(a)(a)?(b)?(x)?", r"\x41", "a{,2}"])
def test_other_patterns_keep_their_meaning(spark, pattern):
    register_functions(spark)
    spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string").createOrReplaceTempView("odd_texts")
    for text in (f"SELECT t, regexp_substr(r'{pattern}', t) AS l FROM odd_texts", "SELECT t, regexp_substr(p, t) AS l FROM odd_texts, (SELECT r'" + pattern + "' AS p)"):
        assert all(r.l == str(re.findall(pattern, r.t)) for r in spark.sql(pattern_first(text)).collect())


def size_text(value):
    try:
        number = int(float(value))
        if number == 0:
            return "0B"
        power = 0
        while number >= 1024 ** (power + 1):
            power += 1
        return f"{round(number / 1024 ** power, 2)} {('B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB', 'ZB', 'YB')[power]}" if number > 0 else "nan"
    except (ValueError, OverflowError, IndexError):
        return "nan"


def test_sizes(spark):
    random.seed(4)
    values = [str(random.randint(0, 2 ** random.randint(1, 50))) for _ in range(1000)]
    values += ["0", "1", "1023", "1024", "1152", "-5", "-0.5", "3.7", "x", "", "1e30", "nan", "inf", str(1024**5)]
    df = spark.createDataFrame([(v,) for v in values], "n string")
    for r in df.select("n", bytes_to_string("n").alias("s")).collect():
        assert r.s == size_text(r.n), r.n


def test_unix_to_iso(spark):
    values = ["0", "1700000000", "1700000000.9996", "5.", ".5", "1.2.3", "-5", "abc", "", "99999999999999", "1e5"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for r in df.select("x", unixtime_to_iso_timestamp("x").alias("o")).collect():
        if r.x.replace(".", "", 1).isdigit() and float(r.x) < 253402300800:
            want = datetime.datetime.fromtimestamp(float(r.x), datetime.timezone.utc).isoformat(sep="T", timespec="milliseconds")
            assert r.o == want
        else:
            assert r.o == r.x


@pytest.mark.parametrize("fmt,good", [
    ("%Y-%m-%dT%H:%M:%S.%f%z", "2025-01-02T03:04:05.678+0300"), ("%Y-%m-%dT%H:%M:%S.%f%z", "2025-01-02T03:04:05.678Z"),
    ("%d/%b/%Y:%H:%M:%S", "02/Jan/2025:03:04:05"), ("%Y%m%d %H%M%S", "20250102 030405"), ("at %Y-%m-%d", "at 2025-01-02"),
    ("%I:%M %p %d.%m.%Y", "03:04 PM 02.01.2025"),
])
def test_epoch(spark, fmt, good):
    parsed = datetime.datetime.strptime(good, fmt)
    want = (parsed if parsed.tzinfo else parsed.replace(tzinfo=datetime.timezone.utc)).timestamp()
    df = spark.createDataFrame([(good,), ("never",), (None,)], "t string")
    assert [r[0] for r in df.select(datetime_to_timestamp("t", fmt)).collect()] == [want, -1.0, -1.0]
    register_functions(spark)
    df.createOrReplaceTempView("epoch_texts")
    rows = spark.sql(f"SELECT datetime_to_timestamp(t, '{fmt}') FROM epoch_texts").collect()
    assert [r[0] for r in rows] == [want, -1.0, -1.0]


def test_unknown_token_is_refused():
    with pytest.raises(ValueError):
        spark_pattern("%Q")


def test_shifted_times(spark):
    df = spark.createDataFrame([("2024-02-28T23:59:59",)], "t string")
    out = df.select(shift_seconds(F.col("t"), 2, "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M:%S"),
                    local_to_epoch_millis(F.col("t"), "Europe/Moscow", "%Y-%m-%dT%H:%M:%S%z")).first()
    moscow = datetime.timezone(datetime.timedelta(hours=3))
    assert out[0] == "29.02.2024 00:00:01"
    assert out[1] == datetime.datetime(2024, 2, 28, 23, 59, 59, tzinfo=moscow).timestamp() * 1000


def test_registered_names(spark):
    register_functions(spark)
    row = spark.sql(pattern_first("""SELECT regexp('a+', 'baab') a, regexp_substr('a', 'banana') b, ip_is_private('10.1.1.1') c,
        unixtime_to_iso_timestamp('0') d, bytes_to_string(2048) e, ip_port2ip('h:1') f, validate_ip_address('::') g""")).first()
    assert tuple(row) == (True, "['a', 'a', 'a']", True, "1970-01-01T00:00:00.000+00:00", "2.0 KB", "h", True)
    assert not math.isnan(row["c"])
    # The built-ins of the same names are as they were, and so are texts, names and the operator.
    assert tuple(spark.sql("SELECT regexp('baab', 'a+'), regexp_substr('banana', 'n.')").first()) == (True, "na")
    kept = "SELECT 'regexp(' || \"regexp_substr(\", t.regexp(1), x REGEXP ('a') -- regexp("
    assert pattern_first(kept) == kept
