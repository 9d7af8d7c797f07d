"""Shift a column by rows inside groups or over the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import attach, col, cols, dtype, fill_missing
from tracewell.operators.aggregate import lists_to_text
from tracewell.operators.ordered import HALO, SLICE, ordering, plan_slices, running, with_look_back
from tracewell.session import cut_lineage

# Cut groups carry the rows of a shift over slice borders up to this length; longer shifts are a join of row numbers.
MANY_ROWS = 1_000


def shift(
    df: DataFrame,
    groupby: Sequence[str],
    target: str,
    result: str,
    periods: int,
    order_by: Sequence[str],
    fill_value=None,
    list_to_text: Mapping[str, str] | None = None,
    fill: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Value of `target` `periods` rows earlier (later when negative).

    `order_by` must name columns that decide the order fully. Rows outside the
    group give `fill_value`, and so do rows with a null in a group column.
    """
    if not order_by:
        raise ValueError("shift needs order_by: a table has no row order")
    df = lists_to_text(df, list_to_text or {})
    # A text filler on a column of another type makes the result text.
    as_text = isinstance(fill_value, str) and not isinstance(dtype(df, target), T.StringType)
    value = col(target).cast("string") if as_text else col(target)
    kind = T.StringType() if as_text else dtype(df, target)
    filler = F.lit(fill_value).cast(kind)
    if periods == 0:
        out = df.withColumn(result, value)
        return out if fill is None else fill_missing(out, fill)

    rows, later = abs(periods), periods < 0
    slices = plan_slices(df, groupby, order_by[0], rows_per_task)
    keys = list(groupby)
    source = df
    if slices.split and rows > MANY_ROWS:
        numbered = cut_lineage(running(df, keys, order_by, {"__place": ("count", F.lit(1))}, slices=slices))
        moved = numbered.select(*cols(keys), (F.col("__place") + periods).alias("__place"), F.struct(value.alias("v")).alias("__earlier"))
        shifted = attach(numbered, moved, [*keys, "__place"])
        shifted = shifted.withColumn(result, F.when(F.col("__earlier").isNull(), filler).otherwise(F.col("__earlier")["v"])).drop("__place", "__earlier")
        return _finished(shifted, groupby, result, filler, fill)
    if slices.split:
        source = with_look_back(df, keys, order_by, rows, slices, descending=later)
        keys = [*keys, SLICE]
    window = Window.partitionBy(*cols(keys)).orderBy(*ordering(order_by, later))
    # lag of a struct tells "no such row" (null) from "a row with a null value".
    earlier = F.lag(F.struct(value.alias("v")), rows).over(window)
    shifted = source.withColumn(result, F.when(earlier.isNull(), filler).otherwise(earlier["v"]))
    if slices.split:
        shifted = shifted.where(~F.col(HALO)).drop(SLICE, HALO)
    return _finished(shifted, groupby, result, filler, fill)


def _finished(shifted: DataFrame, groupby: Sequence[str], result: str, filler: Column, fill: str | None) -> DataFrame:
    if groupby:
        no_group = reduce(lambda a, b: a | b, [col(k).isNull() for k in groupby])
        shifted = shifted.withColumn(result, F.when(no_group, filler).otherwise(col(result)))
    return shifted if fill is None else fill_missing(shifted, fill)
