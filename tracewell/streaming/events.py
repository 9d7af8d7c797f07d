"""Time buckets and row alerts over streams.

The batch operators re-aimed: the interval job that looks for rows becomes an
available-now stream, so every run takes only what is new.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col, cols


def read_events(spark: SparkSession, folder: str, file_pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file_pattern).parquet(folder)


def bucket_stream(
    stream: DataFrame, time_column: str, width: str, keys: Sequence[str], lateness: str, aggregates: Sequence
) -> DataFrame:
    """Tumbling buckets; state is dropped once `lateness` has passed."""
    timed = stream.withColumn("__at", col(time_column).cast("timestamp")).withWatermark("__at", lateness)
    return timed.groupBy(F.window("__at", width).alias("w"), *cols(keys)).agg(*aggregates).select(
        F.col("w.start").alias("bucket"), *cols(keys), *[F.col(f"`{a}`") for a in _names(stream, aggregates)]
    )


def _names(stream: DataFrame, aggregates: Sequence) -> list[str]:
    return stream.groupBy().agg(*aggregates).columns


def run_updates(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available; every changed bucket is appended with its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch repeated after a failure overwrites its own folder only.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        result.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def latest_buckets(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every bucket."""
    updates = spark.read.parquet(path)
    values = [n for n in updates.columns if n not in (*keys, "batch")]
    newest = updates.groupBy(*cols(keys)).agg(F.max_by(F.struct(*cols(values)), F.col("batch")).alias("v"))
    return newest.select(*cols(keys), "v.*")


def run_alert(found: DataFrame, name: str, path: str, checkpoint: str) -> None:
    """Count the rows of each available batch; `found` says whether there are any."""

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.agg(F.count(F.lit(1)).alias("rows_found")).select(
            F.lit(name).alias("result"), "rows_found", (F.col("rows_found") > 0).alias("found")
        )
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def alert_once(stream: DataFrame, keys: Sequence[str], time_column: str, quiet_seconds: int, lateness: str) -> DataFrame:
    """(keys, alert_at): one alert per group when its rows begin, and again only after a quiet time without any.

    A row alerts if no row of its group lies in the `quiet_seconds` up to it. The state is the group's last time; a timer
    drops it once the quiet time is over and `lateness` has passed. Only keys and times are read, eight bytes a row of a
    batch; rows that come after a later one of their group never alert. Null keys are a group, rows without a time are
    left out. Append mode; with a checkpoint a run that stops goes on where it was.
    """
    quiet = quiet_seconds * 1_000_000
    kinds = [T.StructField(f"k{i}", stream.schema[k].dataType) for i, k in enumerate(keys)]
    result = T.StructType([*kinds, T.StructField("alert_at", T.TimestampType())])

    def step(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([c["__at"].to_numpy().astype("datetime64[us]").astype(np.int64) for c in chunks]))
        last = state.get[0] if state.exists else None
        before = np.concatenate([[times[0] - quiet - 1 if last is None else last], times[:-1]])
        starts = times[times - (before if last is None else np.maximum(before, last)) > quiet]
        last = int(times[-1]) if last is None else max(last, int(times[-1]))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + quiet) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if len(starts):
            out = pd.DataFrame({f"k{i}": [value] * len(starts) for i, value in enumerate(key)})
            out["alert_at"] = starts.astype("datetime64[us]")
            yield out

    rows = stream.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], col(time_column).cast("timestamp").alias("__at"))
    rows = rows.where(F.col("__at").isNotNull()).withWatermark("__at", lateness)
    found = rows.groupBy(*[f.name for f in kinds]).applyInPandasWithState(step, result, "last LONG", "append", "EventTimeTimeout")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "alert_at")


def run_append(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available; new rows are appended, each batch in a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = result.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
