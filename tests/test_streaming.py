"""Streams that stop and go on: every run takes what is new."""

from pyspark.sql import functions as F

from tracewell.streaming.events import alert_once, bucket_stream, latest_buckets, read_events, run_alert, run_append, run_updates


def write(spark, folder, name, first, last):
    rows = spark.range(first, last, 1, 1).selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS kind"
    )
    rows.write.mode("append").parquet(f"{folder}/{name}")
    return rows


def test_buckets_over_two_runs(spark, folder):
    sums = [F.count("*").alias("n"), F.max("id").alias("top")]

    def run():
        stream = read_events(spark, f"{folder}/in", "*.parquet", "id LONG, ts TIMESTAMP_NTZ, kind STRING")
        run_updates(bucket_stream(stream, "ts", "1 hour", ["kind"], "3 hours", sums), f"{folder}/out", f"{folder}/state")
        return latest_buckets(spark, f"{folder}/out", ["bucket", "kind"])

    first = write(spark, folder, "in", 0, 100)
    assert sum(r["n"] for r in run().collect()) == 100
    # The second file goes on inside an open bucket.
    both = first.unionByName(write(spark, folder, "in", 100, 200))
    want = both.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "kind").agg(*sums)
    key = lambda r: (str(r["bucket"]), r["kind"], r["n"], r["top"])
    assert sorted(map(key, run().collect())) == sorted(map(key, want.collect()))


def test_alert_counts_only_new_rows(spark, folder):
    def run():
        stream = read_events(spark, f"{folder}/in", "*.parquet", "id LONG, ts TIMESTAMP_NTZ, kind STRING").where("kind = 'a'")
        run_alert(stream, "a", f"{folder}/out", f"{folder}/state")
        return sorted((r["rows_found"], r["found"]) for r in spark.read.parquet(f"{folder}/out").collect())

    write(spark, folder, "in", 0, 9)
    assert run() == [(3, True)]
    write(spark, folder, "in", 9, 10)
    write(spark, folder, "in", 10, 11)
    assert run() == [(1, True), (3, True)]
    assert run() == [(1, True), (3, True)]


def test_alert_once_over_restarts(spark, folder):
    def write_rows(rows):
        times = spark.createDataFrame(rows, "kind string, minute int, alert_at int")
        times.selectExpr("kind", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute) AS ts", "alert_at").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = read_events(spark, f"{folder}/in", "*.parquet", "kind STRING, ts TIMESTAMP_NTZ, alert_at INT")
        run_append(alert_once(stream, ["kind"], "ts", 3600, "10 minutes"), f"{folder}/out", f"{folder}/state")
        found = spark.read.parquet(f"{folder}/out").selectExpr("kind", "CAST(unix_timestamp(alert_at) - unix_timestamp(TIMESTAMP'2024-01-01 00:00:00') AS INT) DIV 60 AS minute")
        return sorted(((r.kind or "", r.minute) for r in found.collect()))

    write_rows([("a", 30, None), ("a", 0, None), ("a", 0, None), ("a", 90, None), ("a", 151, None), ("b", 5, None), (None, 7, None), (None, 8, None), ("c", None, None)])
    first = [("", 7), ("a", 0), ("a", 151), ("b", 5)]
    assert run() == first  # 90 is an hour after 30: still the same alert
    write_rows([("a", 200, None), ("b", 215, None), ("b", 275, None)])  # 49 and 60 minutes are not quiet enough
    assert run() == sorted([*first, ("b", 215)])
    assert run() == sorted([*first, ("b", 215)])
    write_rows([("a", 500, None), ("a", 200, None), ("b", 335, None)])  # late rows never alert
    assert run() == sorted([*first, ("b", 215), ("a", 500)])

