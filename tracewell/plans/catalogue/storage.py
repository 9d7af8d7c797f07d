"""Sources and sinks: data goes to the shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.rows import first_per_key
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import table
from tracewell.session import new_path
from tracewell.sinks.files import append_pages, write_csv, write_json, write_named, write_pages_once, write_parquet
from tracewell.sources.documents import read_json_documents, scan_documents
from tracewell.sources.snapshot import snapshot
from tracewell.sources.static import StaticTables
from tracewell.sources.store import VersionedStore

R = Registry()


@R.query(
    "scan_docs",
    """SELECT CAST(event_id % 3000 AS VARCHAR) AS _id, event_type AS kind, value FROM events
       WHERE value >= 10 AND value < 300 AND event_type IN ('error', 'click', 'view') AND NOT (event_type = 'view' AND value > 200)
         AND (user_id < 500 OR event_type = 'error') AND props IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY ts DESC, event_id DESC) = 1""",
)
def scan_docs(spark, folder):
    """JSON documents in several versions; all four lists of a filter, the newest matching version of each id."""
    path = new_path(spark, "documents")
    events = table(spark, folder, "events").selectExpr(
        "cast(event_id % 3000 AS string) AS _id", "event_type AS kind", "value", "user_id", "props", "cast(ts AS string) AS ts", "event_id AS seq"
    )
    # Overlapping pages repeat documents.
    write_json(events.unionByName(events.where("value > 100")), path)
    documents = read_json_documents(spark, path, "_id STRING, kind STRING, value DOUBLE, user_id BIGINT, props STRING, ts STRING, seq BIGINT")
    query = {
        "bool": {
            "filter": [{"range": {"value": {"gte": 10, "lt": 300}}}, {"exists": {"field": "props"}}],
            "must": {"terms": {"kind": ["error", "click", "view"]}},
            "must_not": [{"bool": {"must": [{"match_phrase": {"kind": "view"}}, {"range": {"value": {"gt": 200}}}]}}],
            "should": [{"range": {"user_id": {"lt": 500}}}, {"term": {"kind": {"value": "error"}}}],
            "minimum_should_match": 1,
        }
    }
    return scan_documents(documents, query, ["kind", "value"], [{"ts": {"order": "desc"}}, {"seq": "desc"}])


def nations(spark, folder):
    """A static table with a row per customer."""
    return table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def loaded(spark, folder):
    store = StaticTables(spark, new_path(spark, "static"))
    store.load(nations(spark, folder), "customers", "ann", "all customers")
    store.load(table(spark, folder, "supplier").select("s_suppkey", "s_name"), "suppliers", "bob", "")
    return store


@R.query("static_read", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer")
def static_read(spark, folder):
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey BIGINT, c_acctbal DOUBLE"
    return loaded(spark, folder).read("customers", schema=schema)


@R.query("static_load", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def static_load(spark, folder):
    """CSV files with a header, types inferred, into a named table and back."""
    csv = new_path(spark, "csv")
    write_csv(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"), csv)
    store = StaticTables(spark, new_path(spark, "static"))
    store.load_csv(csv, "parts", "ann")
    return store.read("parts", schema="p_partkey BIGINT, p_name STRING, p_size BIGINT")


@R.query(
    "static_catalog",
    """SELECT 'customers' AS name, 'ann' AS owner, 'all customers' AS comment, count(*) AS lines FROM customer
       UNION ALL SELECT 'suppliers', 'bob', '', count(*) FROM supplier""",
)
def static_catalog(spark, folder):
    return loaded(spark, folder).catalogue().select("name", "owner", F.coalesce("comment", F.lit("")).alias("comment"), "lines")


@R.query("static_delete", "SELECT 'suppliers' AS name, s_suppkey AS id FROM supplier")
def static_delete(spark, folder):
    store = loaded(spark, folder)
    store.delete("customers")
    return store.rows().select("name", F.get_json_object("json", "$.s_suppkey").cast("bigint").alias("id"))


def kinds(spark, folder):
    """A store with a table loaded in three parts, clicks first, nulls with the last."""
    store = VersionedStore(spark, new_path(spark, "store"))
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    kind = F.coalesce("event_type", F.lit(""))
    first = store.append("events", events.where(kind == "click"))
    second = store.append("events", events.where(kind == "view"))
    store.append("events", events.where(~kind.isin("click", "view")))
    return store, first, second


@R.query("store_compact", "SELECT event_id, event_type, value, 1 AS parts FROM events")
def store_compact(spark, folder):
    """Three parts become one with the same rows; versions and folders before it are dropped."""
    store, _, _ = kinds(spark, folder)
    store.compact("events")
    store.expire(1)
    return store.read("events").withColumn("parts", F.lit(len(store.parts(name="events"))))


@R.query(
    "store_as_of",
    """SELECT 'first' AS version, event_id, value FROM events WHERE event_type = 'click'
       UNION ALL SELECT 'second', event_id, value FROM events WHERE event_type IN ('click', 'view')
       UNION ALL SELECT 'newest', s_suppkey, s_acctbal FROM supplier""",
)
def store_as_of(spark, folder):
    """Earlier versions read the same after the table was compacted, deleted and loaded anew."""
    store, first, second = kinds(spark, folder)
    store.compact("events")
    store.delete("events")
    store.append("events", table(spark, folder, "supplier").selectExpr("s_suppkey AS event_id", "s_acctbal AS value"))
    versions = {"first": store.read("events", first), "second": store.read("events", second), "newest": store.read("events")}
    parts = [df.select(F.lit(k).alias("version"), "event_id", "value") for k, df in versions.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("ttl_snapshot", "SELECT event_type, count(*) AS n, round(max(value), 2) AS top FROM events GROUP BY event_type")
def ttl_snapshot(spark, folder):
    """The second call finds the first one's result, young enough."""
    root = new_path(spark, "snapshots")

    def build():
        return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("top"))

    snapshot(spark, root, "by_type", 300, build)
    return snapshot(spark, root, "by_type", 300, lambda: build().where("false"))


@R.query("sink_csv", "SELECT doc_id, text, lang FROM documents")
def sink_csv(spark, folder):
    """Texts with line breaks, quotes and commas survive the file."""
    path = new_path(spark, "csv")
    write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.csv(path, header=True, schema="doc_id BIGINT, text STRING, lang STRING", multiLine=True, escape='"')


@R.query(
    "sink_multi",
    "SELECT 'customer' AS result, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_orderkey FROM orders",
)
def sink_multi(spark, folder):
    results = {
        "customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
        "orders": table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")),
    }
    paths = write_named(results, new_path(spark, "archive"), "csv")
    parts = [
        spark.read.csv(p, header=True, schema="id BIGINT").select(F.lit(n).alias("result"), "id") for n, p in paths.items()
    ]
    return parts[0].unionByName(parts[1])


@R.query("sink_json", "SELECT conv_id, turn, role, text FROM conversations")
def sink_json(spark, folder):
    path = new_path(spark, "json")
    write_json(table(spark, folder, "conversations"), path)
    return read_json_documents(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


@R.query("sink_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sink_parquet(spark, folder):
    path = new_path(spark, "result")
    write_parquet(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), path)
    return spark.read.parquet(path)


@R.query("sink_append", "SELECT event_id AS _id, event_type FROM events")
def sink_append(spark, folder):
    """Two overlapping pages appended; repeats go when the export is read."""
    path = new_path(spark, "append")
    events = table(spark, folder, "events").select(F.col("event_id").alias("_id"), "event_type")
    append_pages(events.where("event_type <> 'click'"), path)
    append_pages(events.where("event_type <> 'view'"), path)
    stored = spark.read.csv(path, header=True, schema="_id BIGINT, event_type STRING")
    return first_per_key(stored, ["_id"], ["_id"])


@R.query(
    "sink_pages_once",
    """SELECT user_id AS _id, arg_min(event_type, CASE event_type WHEN 'error' THEN '0' WHEN 'view' THEN '1' ELSE '2' || event_type END) AS event_type
       FROM events GROUP BY user_id""",
)
def sink_pages_once(spark, folder):
    """Three overlapping pages; every id is written once, from the first page that has it."""
    path = new_path(spark, "once")
    events = table(spark, folder, "events").select(F.col("user_id").alias("_id"), "event_type")
    pages = (events.where(c) for c in ("event_type = 'error'", "event_type = 'view'", "true"))
    write_pages_once(pages, path, new_path(spark, "pages"))
    return spark.read.csv(path, header=True, schema="_id BIGINT, event_type STRING")
