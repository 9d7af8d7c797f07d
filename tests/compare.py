"""Run registered queries next to their SQL in DuckDB: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def row_counts(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "double": "double", "float": "double",
         "string": "varchar", "boolean": "boolean", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "date": "date"}


def compare(spark, con, name, query, sql, folder) -> str:
    started = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(rows)} rows {seconds:.1f}s"
    relation = con.sql(sql)
    left = row_counts(df.columns, rows)
    right = row_counts(relation.columns, relation.fetchall())
    kinds = dict(zip(df.columns, (KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields)))
    other = {n: str(t).lower().replace("integer", "int") for n, t in zip(relation.columns, relation.types)}
    types = {n: (kinds[n], other.get(n)) for n in kinds if kinds[n] != other.get(n)}
    note = f" types {types}" if types else ""
    if left == right:
        return f"ok {len(rows)} rows {seconds:.1f}s{note}"
    if left[0] != right[0]:
        return f"DIFF columns {left[0]} {right[0]}"
    mine, theirs = left[1] - right[1], right[1] - left[1]
    return f"DIFF rows {len(rows)} vs {sum(right[1].values())}: only spark {list(mine.items())[:2]} only sql {list(theirs.items())[:2]}{note}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, chosen = entry.oracle_sql(), sys.argv[2:]
    total = time.time()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            print(name, compare(session, con, name, query, oracles.get(name), folder), flush=True)
        except Exception as error:
            print(name, "ERROR", type(error).__name__, str(error)[:600], flush=True)
    print(f"total {time.time() - total:.0f}s")
