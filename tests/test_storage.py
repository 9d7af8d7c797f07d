"""Sources, sinks, snapshots, static tables, steps and streams."""

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracewell.plans.steps import Step, nested_chain, run_chain, shown, sql_step
from tracewell.sinks.files import append_pages, write_csv, write_named, write_pages_once
from tracewell.sources.database import jdbc_options
from tracewell.sources.documents import filter_column, scan_documents
from tracewell.sources.snapshot import snapshot
from tracewell.sources.static import StaticTables
from tracewell.sources.store import Conflict, VersionedStore


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "SELECT 1;", ["SET a = 1;", "SET b = 2"], timeout=5, database="postgresql")
    assert plain["query"] == "SELECT 1" and plain["sessionInitStatement"] == "SET a = 1; SET b = 2"
    assert plain["queryTimeout"] == "5" and plain["driver"] == "org.postgresql.Driver"
    parts = jdbc_options("jdbc:x", "SELECT * FROM t", partition={"column": "id", "lower": 0, "upper": 9, "parts": 3})
    assert parts["dbtable"] == "(SELECT * FROM t) final_query" and parts["numPartitions"] == "3" and "query" not in parts


def test_scan_documents(spark):
    rows = [("1", "a", 5, ["x"]), ("1", "a", 6, None), ("2", "a", 9, ["y", "x"]), ("3", "b", 7, []), ("4", None, 1, ["z"])]
    docs = spark.createDataFrame(rows, "_id string, k string, v int, tags array<string>")

    def ids(query):
        return sorted(r[0] for r in docs.where(filter_column(docs, query)).collect())

    query = {"bool": {"filter": [{"range": {"v": {"gt": 1, "lte": "9"}}}, {"match_phrase": {"k": {"query": "a"}}}]}}
    for way, first in (("desc", 6), ("asc", 5)):
        assert {tuple(r) for r in scan_documents(docs, query, ["v"], [{"v": {"order": way}}]).collect()} == {("2", 9), ("1", first)}
    assert [tuple(r) for r in scan_documents(docs, query, ["v"], [{"k": "asc"}, {"v": "desc"}], ordered=True).collect()] == [("2", 9), ("1", 6)]
    assert ids({}) == ids({"match_all": {}}) == ["1", "1", "2", "3", "4"]
    assert ids({"range": {"v": {"gte": 7}}}) == ["2", "3"]
    assert ids({"bool": {"must_not": [{"term": {"k": "a"}}]}}) == ["3", "4"]  # a missing value is not "a"
    assert ids({"bool": {"should": [{"term": {"k": "b"}}, {"terms": {"v": [1, 9]}}]}}) == ["2", "3", "4"]
    assert ids({"bool": {"must": {"exists": {"field": "k"}}, "should": [{"term": {"k": "b"}}]}}) == ["1", "1", "2", "3"]
    assert ids({"term": {"tags": "x"}}) == ["1", "2"]
    for bad in ({"wildcard": {}}, {"bool": {"filter": [{"wildcard": {}}]}}, {"range": {"v": {"gte": 1, "format": "x"}}}, {"bool": {"boost": 1}}, {"term": {"v": {"value": 1, "boost": 2}}}, {"exists": {"field": "v"}, "term": {}}):
        with pytest.raises(ValueError):
            filter_column(docs, bad)
    with pytest.raises(ValueError):
        scan_documents(docs, {}, ["v"], [{"v": {"order": "desc", "missing": "_first"}}])


def test_filters_reach_the_scan(spark, folder):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS other").write.parquet(f"{folder}/t")
    docs = spark.read.parquet(f"{folder}/t").withColumnRenamed("id", "_id")
    out = scan_documents(docs, {"bool": {"filter": [{"range": {"v": {"gte": 10}}}]}}, ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,10)" in plan and "other" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_static_tables(spark, folder):
    store = StaticTables(spark, folder)
    store.load(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), "one", "ann", "c")
    write_csv(spark.createDataFrame([(1.5, "x, \"y\"")], "n double, t string"), f"{folder}/csv")
    store.load_csv(f"{folder}/csv", "two", "bob")
    assert sorted(r["a"] for r in store.read("one").collect()) == [1, 2]
    assert tuple(store.read("two").select("n", "t").first()) == (1.5, 'x, "y"')
    assert store.read("one", limit=1).count() == 1
    assert [(r["name"], r["lines"]) for r in store.catalogue().collect()] == [("one", 2), ("two", 1)]
    store.delete("one")
    assert {r["name"] for r in store.rows().select("name").collect()} == {"two"}
    with pytest.raises(ValueError):
        store.read("one")
    store.load(spark.createDataFrame([(9,)], "a int"), "one", "ann")
    assert [r["a"] for r in store.read("one").collect()] == [9]


def test_snapshot(spark, folder):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert snapshot(spark, folder, "s", 10, build, now=100.0).count() == 1
    assert snapshot(spark, folder, "s", 10, build, now=110.0).count() == 1
    assert snapshot(spark, folder, "s", 10, build, now=110.5).count() == 2
    assert snapshot(spark, folder, "other", 10, build, now=110.5).count() == 3

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        snapshot(spark, folder, "s", 10, broken, now=200.0)
    assert snapshot(spark, folder, "s", 1000, build, now=200.0).count() == 2


def test_store_versions(spark, folder):
    store = VersionedStore(spark, f"{folder}/a b")  # a folder with a blank
    assert store.versions() == [] and store.parts() == []
    with pytest.raises(ValueError):
        store.read("t")
    rows = spark.createDataFrame([(1, "x"), (None, None), (1, "x")], "a int, b string")
    one = store.append("t", rows, "ann", "c")
    two = store.append("t", spark.createDataFrame([(2, 0.5)], "a int, c double"))
    store.append("other \u00e9/..", rows.limit(0))
    assert Counter(map(tuple, store.read("t").select("a", "b", "c").collect())) == Counter([(1, "x", None)] * 2 + [(None, None, None), (2, None, 0.5)])
    before = sorted(map(str, store.read("t").select("a", "b", "c").collect()))
    store.compact("t")
    assert len(store.parts(name="t")) == 1 and len(store.parts(two, "t")) == 2 and len(store.parts()) == 2
    assert sorted(map(str, store.read("t").select("a", "b", "c").collect())) == before
    assert store.compact("t") == store.versions()[-1] == 4  # one part: nothing to do
    assert store.read("other \u00e9/..").count() == 0
    store.delete("t")
    assert store.read("t", one).count() == 3
    with pytest.raises(ValueError):
        store.read("t")
    assert store.replace("t", rows) == 6 and store.replace("t", rows.where("a = 1")) == 7
    assert store.read("t").count() == 2 and store.read("t", 6).count() == 3
    waiting = store.written(rows, "t")  # a writer that has not committed
    assert len(store.expire(1)) == 4 and store.versions() == [7] and store.read("t").count() == 2
    store.commit(lambda listed: [*listed, waiting])
    assert store.read("t").count() == 5 and store.expire(5) == []
    with pytest.raises(ValueError):
        store.expire(0)


def test_store_with_two_writers(spark, folder):
    stores = [VersionedStore(spark, folder) for _ in range(2)]
    rows = [spark.range(k, k + 1).cache() for k in range(12)]
    with ThreadPoolExecutor(2) as both:
        done = list(both.map(lambda k: stores[k % 2].append("t", rows[k]), range(12)))
    assert sorted(done) == list(range(1, 13)) and sorted(r.id for r in stores[0].read("t").collect()) == list(range(12))
    # Each sees what the other committed between its look and its commit.
    calls = []

    def late(listed):
        calls.append(len(listed))
        if len(calls) == 1:
            stores[1].delete("t")
        return [*listed, stores[0].written(rows[0], "u")]

    assert stores[0].commit(late) == 14 and calls == [12, 0] and [p.name for p in stores[1].parts()] == ["u"]
    # A compaction gives way to a delete, and leaves appended parts alone.
    for k in (1, 2):
        stores[0].append("t", rows[k])
    written = stores[0].written

    def meanwhile(act):
        def write(*args):
            part = written(*args)
            act()
            return part

        stores[0].written = write

    meanwhile(lambda: stores[1].append("t", rows[3]))
    stores[0].compact("t")
    assert len(stores[1].parts(name="t")) == 2 and sorted(r.id for r in stores[1].read("t").collect()) == [1, 2, 3]
    meanwhile(lambda: stores[1].delete("t"))
    with pytest.raises(Conflict):
        stores[0].compact("t")
    assert stores[1].parts(name="t") == []


def test_store_commits_by_rename_where_files_are_not_local(spark, folder):
    store = VersionedStore(spark, folder)
    store._local = None
    assert store.append("t", spark.range(3)) == 1 and store.append("t", spark.range(2)) == 2
    assert not store._create(store._file(2), "[]") and store.read("t").count() == 5
    store.compact("t")
    assert store.versions() == [1, 2, 3] and store.read("t").count() == 5


def test_snapshot_of_two_builders(spark, folder):
    def slower():
        snapshot(spark, folder, "s", 10, lambda: spark.range(7), now=100.0)
        return spark.range(9)

    assert snapshot(spark, folder, "s", 10, slower, now=101.0).count() == 7


def test_csv_loads(spark, folder):
    write_csv(spark.createDataFrame([(1, "a\nb"), (2, None)], "n int, t string"), f"{folder}/lines")
    store = StaticTables(spark, f"{folder}/store")
    store.load_csv(f"{folder}/lines", "lines", "ann", schema="n INT, t STRING", multiline=True)
    store.load_csv(f"{folder}/lines", "lines", "ann", multiline=True)
    store.compact("lines")
    got = Counter(map(tuple, store.read("lines", schema="n INT, t STRING").collect()))
    assert got == {(1, "a\nb"): 2, (2, None): 2} and len(store.store.parts()) == 1


def test_files(spark, folder):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", [1, 2])], "id int, t string, l array<int>")
    paths = write_named({"x": df, "y": df.drop("l")}, folder, "csv")
    back = spark.read.csv(paths["x"], header=True, schema="id INT, t STRING, l STRING", multiLine=True, escape='"')
    assert tuple(back.first()) == (1, "a,\"b\"\nc", "[1,2]")
    with pytest.raises(Exception):
        write_csv(df, paths["x"])
    page = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "_id string, v string")
    append_pages(page, f"{folder}/pages")
    append_pages(page, f"{folder}/pages", dedupe=False)
    assert spark.read.csv(f"{folder}/pages", header=True).count() == 5


def test_sql_step(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    spark.range(7).createOrReplaceTempView("a")
    out = sql_step(spark, {"a": a, "none": a.where("false")}, "SELECT count(*) AS n, :word AS w FROM a LEFT JOIN b USING (id) LEFT JOIN none USING (id)",
                   [("b", "SELECT id FROM a WHERE t = ''")], {"word": "it's"}, to_text=True)
    assert tuple(out.first()) == (2, "it's")
    # Views of the session are as they were.
    assert spark.table("a").count() == 7 and not spark.catalog.tableExists("b")
    spark.catalog.dropTempView("a")
    with pytest.raises(Exception):
        sql_step(spark, {"a": a}, "UPDATE a SET id = 3")


def test_chains(spark):
    def chain(least):
        steps = [Step("big", lambda r: r["rows"].where(F.col("id") >= least), show=False), Step("sum", lambda r: r["big"].agg(F.sum("id").alias("s")))]
        results = run_chain(steps, {"rows": spark.range(10)})
        assert list(shown(steps, results)) == ["sum"]
        return results

    assert nested_chain(chain, "sum", least=7).first()["s"] == 24
    with pytest.raises(ValueError):
        nested_chain(chain, "nothing", least=1)
    with pytest.raises(ValueError):
        run_chain([Step("rows", lambda r: r["rows"])], {"rows": spark.range(1)})


def test_pages_once(spark, folder):
    """The first page wins; ties, a null id, a hot id, a column only one page has, and names that clash."""
    schema = "_id string, v string, row int"
    first = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), (None, "n", 3)], schema)
    second = spark.createDataFrame([("hot", "same", 1)] * 300 + [("1", "0", 0), (None, "m", 0)], schema)
    third = spark.createDataFrame([("hot", "x", None), ("3", None, "late")], "_id string, v string, more string")
    taken = []
    pages = (taken.append(1) or page for page in (first, first.where("false"), second, third))
    write_pages_once(pages, f"{folder}/once", f"{folder}/work")
    back = spark.read.csv(f"{folder}/once", header=True, schema="_id STRING, v STRING, row INT, more STRING")
    assert {tuple(r) for r in back.collect()} == {("1", "a", 2, None), (None, "n", 3, None), ("hot", "same", 1, None), ("3", None, None, "late")}
    assert back.count() == 4 and len(taken) == 4
    write_pages_once([first.where("false")], f"{folder}/empty", f"{folder}/work2")
    assert spark.read.csv(f"{folder}/empty", header=True, schema=schema).count() == 0
    with pytest.raises(ValueError):
        write_pages_once([], f"{folder}/none", f"{folder}/work3")
