"""Sketch tables: distinct counts and quantiles per bucket that are stored, added to and rolled up without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.aggregate import CALENDAR, bucket_start, fixed_seconds

LG_K = 12  # HyperLogLog with 2 ** LG_K registers: a standard error of 1.04 / 2 ** (LG_K / 2), 1.6 %
KLL_K = 200  # a quantile's rank is off by at most 1.33 % of the rows, in 99 of 100 sketches


def _bucket(df: DataFrame, time: str, frequency: str) -> Column:
    if frequency not in CALENDAR and 86400 % fixed_seconds(frequency):
        raise ValueError(f"stored buckets need a calendar length or one that divides a day, not {frequency}: others begin where the rows begin")
    return bucket_start(df, time, frequency)


def build_sketches(
    df: DataFrame, keys: Sequence[str], time: str, frequency: str, distinct: Sequence[str] = (), quantiles: Sequence[str] = (),
    lg_k: int = LG_K, kll_k: int = KLL_K,
) -> DataFrame:
    """(keys, `time` as bucket start, rows, distinct_<column>, quantile_<column>): one row of sketches per group and bucket.

    Nulls are in no sketch: a group with nulls only has a sketch of nothing. Null keys are a group of their own, rows
    without a time are in the bucket null. Distinct columns are whole numbers, text or bytes; quantile columns numbers, in
    which NaN counts as missing. Partial aggregates: no group meets in one task, whatever its share of the rows.
    """
    rows = df.withColumn("__bucket", _bucket(df, time, frequency))
    number = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in quantiles}
    return rows.groupBy(*cols(keys), F.col("__bucket").alias(time)).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(col(c), lg_k).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(number[c], kll_k).alias(f"quantile_{c}") for c in quantiles],
    )


def roll_up(sketches: DataFrame, keys: Sequence[str], time: str | None = None, frequency: str | None = None) -> DataFrame:
    """The sketches of fewer keys, longer buckets or, without `time`, of all times: merged from the stored ones alone.

    Several rows of one group and bucket, as appended parts leave them, become one. Longer buckets must be made of whole
    stored ones. The distinct sketch equals that of the rows; a quantile sketch keeps the error of its size.
    """
    group = cols(keys)
    if time is not None:
        sketches = sketches.withColumn("__bucket", _bucket(sketches, time, frequency) if frequency else col(time))
        group = [*group, F.col("__bucket").alias(time)]
    merged = [F.sum("rows").alias("rows")]
    for name in sketches.columns:
        if name.startswith("distinct_"):
            merged.append(F.hll_union_agg(col(name)).alias(name))
        elif name.startswith("quantile_"):
            merged.append(F.kll_merge_agg_double(col(name)).alias(name))
    return sketches.groupBy(*group).agg(*merged)


def estimates(sketches: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """The same rows with numbers: about_<column> distinct values, and <column>_at the shares, as a list (null of nothing)."""
    out = []
    for name in sketches.columns:
        if name.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(col(name)).alias(f"about_{name.removeprefix('distinct_')}"))
        elif name.startswith("quantile_"):
            held = F.kll_sketch_get_n_double(col(name)) > 0
            found = F.array(*[F.kll_sketch_get_quantile_double(col(name), F.lit(float(s))) for s in shares])
            out.append(F.when(held, found).alias(f"{name.removeprefix('quantile_')}_at"))
        else:
            out.append(col(name))
    return sketches.select(*out)


class SketchTable:
    """Stored sketches below a folder: parts are appended as rows arrive, and read as one."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], time: str) -> None:
        self.spark, self.path, self.keys, self.time = spark, path.rstrip("/"), list(keys), time

    def append(self, sketches: DataFrame) -> None:
        """Add the sketches of further rows; those of buckets that are there already are merged when read."""
        sketches.write.mode("append").parquet(self.path)

    def read(self, frequency: str | None = None) -> DataFrame:
        """One row per group and bucket, of the stored length or a longer one."""
        return roll_up(self.spark.read.parquet(self.path), self.keys, self.time, frequency)
