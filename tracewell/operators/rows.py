"""First row per key, newest row per key, tagged unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Distinct on `keys`, keeping the earliest row: a partial aggregate, no window."""
    place = F.struct(*cols(order_by))
    kept = df.groupBy(*cols(keys)).agg(F.min_by(F.struct(*cols(df.columns)), place).alias("row"))
    return kept.select(*[F.col("row").getField(n).alias(n) for n in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row of every key."""
    place = F.struct(*cols(order_by))
    kept = df.groupBy(*cols(keys)).agg(F.max_by(F.struct(*cols(df.columns)), place).alias("row"))
    return kept.select(*[F.col("row").getField(n).alias(n) for n in df.columns])


def union_tagged(inputs: Mapping[str, DataFrame], tag: str = "_data_name_") -> DataFrame:
    """Concatenate by column name, keep duplicates, add each input's name."""
    if not isinstance(inputs, Mapping) or not inputs:
        raise ValueError("union needs a non-empty mapping of names to tables")
    parts = [df.withColumn(tag, F.lit(name)) for name, df in inputs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def newest(df: DataFrame, by: Sequence[str], rows: int, offset: int = 0) -> DataFrame:
    """Newest-first list with a cap, the report form: top-k per partition, then merged."""
    ordered = df.orderBy(*[col(n).desc() for n in by])
    return (ordered.offset(offset) if offset else ordered).limit(rows)
