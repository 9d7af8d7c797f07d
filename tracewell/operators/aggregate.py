"""Grouped aggregation with several functions per column, and time buckets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import attach, col, cols, dtype, fill_missing, quote
from tracewell.functions.times import spark_pattern
from tracewell.operators.ordered import median_values
from tracewell.session import cut_lineage

Spec = Mapping[str, str | Sequence[str]]

# Built-in aggregates with a partial (map-side) form, by function name.
# An all-null sum is 0; counts skip nulls; spread measures use n - 1.
PARTIAL = {
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "var": lambda c: F.var_samp(c),
    "nunique": lambda c: F.count_distinct(c),
    "size": lambda c: F.count(F.lit(1)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    # Adjusted for the sample size; null for fewer than three values.
    "skew": lambda c: F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / (F.count(c) - 2)),
    "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
}
ORDERED = {"first": F.min_by, "last": F.max_by}


def lists_to_text(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """List cells become comma-joined text in a new column; other cells are kept."""
    for source, target in mapping.items():
        if isinstance(dtype(df, source), T.ArrayType):
            text = F.array_join(F.transform(col(source), lambda x: x.cast("string")), ",", "None")
        else:
            text = col(source)
        df = df.withColumn(target, text)
    return df


def expand_spec(spec: Spec) -> list[tuple[str, str, str]]:
    """(column, function, output name) triples; a bare function keeps the name."""
    out = []
    for column, functions in spec.items():
        if isinstance(functions, str):
            out.append((column, functions, column))
        else:
            out.extend((column, fn, f"{column}_{fn}") for fn in functions)
    return out


def aggregate_columns(triples: Sequence[tuple[str, str, str]], order_by: Sequence[str]) -> list[Column]:
    result = []
    for column, fn, name in triples:
        if fn in ORDERED:
            if not order_by:
                raise ValueError(f"{fn} of {column} needs order_by: a table has no row order")
            place = F.when(col(column).isNotNull(), F.struct(*cols(order_by)))
            result.append(ORDERED[fn](col(column), place).alias(name))
        elif fn in PARTIAL:
            result.append(PARTIAL[fn](col(column)).alias(name))
        else:
            raise ValueError(f"unknown aggregate {fn}; known: {sorted([*PARTIAL, *ORDERED, 'median'])}")
    return result


def aggregate(
    df: DataFrame,
    groupby: Sequence[str],
    spec: Spec,
    list_to_text: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
    fill: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Group by `groupby` (null is a group of its own) and aggregate.

    `order_by` gives first/last their row order. `fill="-"` shows missing
    values as text and turns nullable columns into strings.
    """
    df = lists_to_text(df, list_to_text or {})
    triples = expand_spec(spec)
    medians = [t for t in triples if t[1] == "median"]
    plain = [t for t in triples if t[1] != "median"]
    grouped = df.groupBy(*cols(groupby))
    out = grouped.agg(*aggregate_columns(plain, order_by)) if plain else df.select(*cols(groupby)).distinct()
    for column, _, name in medians:
        values = df.select(*cols(groupby), col(column).alias("__value"))
        out = attach(out, median_values(values, groupby, "__value", name, rows_per_task), groupby)
    out = out.select(*cols(groupby), *[col(name) for _, _, name in triples])
    return out if fill is None else fill_missing(out, fill)


# Frequency aliases and their lengths in seconds.
FIXED_SECONDS = {"s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86400}
CALENDAR = ("W", "M", "ME", "MS", "Q", "QE", "QS", "Y", "YE", "YS")
# End of fixed values.


def bucket_start(df: DataFrame, key: str, frequency: str) -> Column:
    """Label of the time bucket of each row, as a naive timestamp.

    Fixed lengths are counted from midnight of the first day seen; lengths that
    divide a day need no look at the data. Calendar buckets are labelled by
    their last day, the `S` forms by their first, weeks by their Sunday.
    """
    time = col(key).cast("timestamp_ntz")
    if frequency in CALENDAR:
        day = time.cast("date")
        label = {
            "W": F.date_add(F.date_trunc("week", time).cast("date"), 6),
            "M": F.last_day(day),
            "MS": F.trunc(day, "month"),
            "Q": F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
            "QS": F.trunc(day, "quarter"),
            "Y": F.last_day(F.add_months(F.trunc(day, "year"), 11)),
            "YS": F.trunc(day, "year"),
        }[frequency.removesuffix("E") if frequency in ("ME", "QE", "YE") else frequency]
        return label.cast("timestamp_ntz")
    seconds = fixed_seconds(frequency)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, time)
    origin = 0
    if 86400 % seconds:
        first = df.agg(F.min(F.unix_date(time.cast("date")))).first()[0]
        origin = (first or 0) * 86_400_000_000
    width = seconds * 1_000_000
    start = F.floor((micros - F.lit(origin)) / F.lit(width)) * F.lit(width) + F.lit(origin)
    return F.timestamp_add("MICROSECOND", start, epoch)


def fixed_seconds(frequency: str) -> int:
    match = re.fullmatch(r"(\d*)([A-Za-z]+)", frequency)
    if not match or match.group(2) not in FIXED_SECONDS:
        raise ValueError(f"unknown frequency {frequency}")
    return int(match.group(1) or 1) * FIXED_SECONDS[match.group(2)]


def parse_time(df: DataFrame, key: str, time_format: str | None) -> DataFrame:
    """Text times by a strptime format; a bad value fails the job."""
    if isinstance(dtype(df, key), T.StringType):
        pattern = spark_pattern(time_format) if time_format else None
        parsed = F.to_timestamp(col(key), pattern) if pattern else F.to_timestamp(col(key))
        return df.withColumn(key, parsed)
    return df


def aggregate_by_time(
    df: DataFrame,
    groupby: Sequence[str],
    spec: Spec,
    key: str,
    frequency: str,
    time_format: str | None = None,
    list_to_text: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
    fill: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """`aggregate` with the time bucket of `key` as the last group column.

    With other group columns only buckets that occur are returned; without any,
    empty buckets between the first and the last are filled in.
    """
    df = parse_time(df, key, time_format)
    df = df.withColumn("__bucket", bucket_start(df, key, frequency))
    out = aggregate(df, [*groupby, "__bucket"], spec, list_to_text, order_by, None, rows_per_task)
    if not groupby:
        # Kept: the buckets give both their range and the joined rows.
        out = fill_buckets(cut_lineage(out), "__bucket", frequency, spec)
    if any(name == key for _, _, name in expand_spec(spec)):
        raise ValueError(f"an aggregate may not be named like the time column {key}")
    out = out.withColumnRenamed("__bucket", key)
    return out if fill is None else fill_missing(out, fill)


STEP = {
    "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "MS": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS",
    "QS": "INTERVAL 3 MONTHS", "Y": "INTERVAL 1 YEAR", "YS": "INTERVAL 1 YEAR",
}


def fill_buckets(df: DataFrame, bucket: str, frequency: str, spec: Spec) -> DataFrame:
    """Left-join the full bucket sequence; counts and sums of empty buckets are 0."""
    name = quote(bucket)
    bounds = df.agg(F.min(col(bucket)).alias("lo"), F.max(col(bucket)).alias("hi"))
    if frequency in CALENDAR:
        unit = frequency.removesuffix("E") if frequency in ("ME", "QE", "YE") else frequency
        month_end = unit in ("M", "Q", "Y")
        # Step over month starts, then move each back to its month's last day.
        low = "date_trunc('month', lo)" if month_end else "lo"
        steps = bounds.select(F.expr(f"explode(sequence({low}, hi, {STEP[unit]})) AS at"))
        label = F.last_day(F.col("at").cast("date")) if month_end else F.col("at")
        every = steps.select(label.cast("timestamp_ntz").alias(bucket))
    else:
        # Numbered by all tasks together: ten years of seconds are no list in one row.
        seconds = fixed_seconds(frequency)
        low, last = bounds.select(F.col("lo").cast("string"), F.expr(f"timestampdiff(SECOND, lo, hi) div {seconds}")).first()
        begin = F.lit(low).cast("timestamp_ntz").alias("lo")
        every = df.sparkSession.range(0 if low is None else last + 1).select("id", begin).select(F.expr(f"lo + make_dt_interval(0, 0, 0, id * {seconds}) AS {name}"))
    joined = attach(every, df, [bucket])
    zero = {out for _, fn, out in expand_spec(spec) if fn in ("count", "sum", "size", "nunique")}
    return joined.select(
        *[F.coalesce(col(n), F.lit(0)).alias(n) if n in zero else col(n) for n in [bucket] + [c for c in df.columns if c != bucket]]
    )


def result_counts(results: Mapping[str, DataFrame], shown: Sequence[str] | None = None) -> DataFrame:
    """Rows per named result and whether any shown result has rows."""
    names = list(results)
    shown = names if shown is None else list(shown)
    parts = [
        results[n].agg(F.count(F.lit(1)).alias("rows_found")).select(
            F.lit(n).alias("result"), F.lit(n in shown).alias("shown"), F.col("rows_found")
        )
        for n in names
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    # The window holds one row per named result.
    most = F.max(F.when(F.col("shown"), F.col("rows_found")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    return counts.select("result", "shown", "rows_found", (most > 0).alias("found"))
