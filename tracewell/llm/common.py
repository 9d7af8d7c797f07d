"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.session import new_path

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 16_000_000  # bytes of text behind one partition of a shuffle
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


@contextmanager
def _shuffles_dropped(df: DataFrame) -> Iterator[DataFrame]:
    """`df` to be written: Spark removes the shuffle files behind it when that has ended, not when the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        yield df.select("*")  # planned anew, as a plan keeps the setting that it was made under
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to a new folder below spark.checkpoint.dir and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    with _shuffles_dropped(df) as rows:
        rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the values of the columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def content_key(text: Column) -> Column:
    """128 bits that stand for a text: equal for equal texts only, for all that matters here; null for null."""
    return F.when(text.isNotNull(), F.unhex(F.md5(F.encode(text, "UTF-8"))))


def shuffle_slices(rows: DataFrame, column: str = "text", slice_bytes: int = SLICE_BYTES) -> int:
    """Partitions for work on a column of this many bytes, and not fewer than the session's."""
    size = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // slice_bytes))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text_key, text binary, n) of the distinct texts, null as empty, written bucketed by key: later joins move no text."""
    spark = docs.sparkSession
    bytes_ = F.coalesce(col("text").cast("binary"), F.lit(b""))
    rows = docs.select(text_key(col("text")).alias("text_key"), bytes_.alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as the aggregation leaves them: no second shuffle
    once = rows.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    name = f"tracewell_texts_{uuid4().hex}"
    with _shuffles_dropped(once) as once:
        writer = once.write.bucketBy(buckets, "text_key").sortBy("text_key").option("compression", "zstd")
        writer.option("path", new_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write a table bucketed and sorted by a key, as an aggregation by it leaves the rows: later joins by the key do not move it."""
    spark = df.sparkSession
    name = f"tracewell_{label.replace('-', '_')}_{uuid4().hex}"
    with _shuffles_dropped(df) as rows:
        writer = rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("compression", "zstd")
        writer.option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def text_key(text: Column) -> Column:
    return content_key(F.coalesce(text, F.lit("")))
