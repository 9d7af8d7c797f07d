"""apply: run one query for every row of a table, as joins.

Each row of the target binds parameters; result rows carry them as
`applied_<name>` so that they can be joined back. Repeated target rows give
repeated results, an empty target gives none.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.ordered import as_number
from tracewell.operators.ranges import range_join
from tracewell.operators.rows import first_per_key
from tracewell.plans.steps import sql_step


@dataclass(frozen=True)
class Bind:
    """Parameter `name` from `column`, optionally put into a text pattern."""

    column: str
    name: str
    pattern: str | None = None


# The pattern fields.
PATTERN_VALUE, PATTERN_DATA, PATTERN_COLUMN, PATTERN_AS = (
    "__pattern_value__", "__pattern_data__", "__pattern_column__", "__pattern_as__",
)
# End of fixed values.


def pattern_column(bind: Bind, data_name: str) -> Column:
    """The pattern as a concatenation of literals and the bound column."""
    if bind.pattern is None:
        return col(bind.column)
    fields = {
        PATTERN_VALUE: F.coalesce(col(bind.column).cast("string"), F.lit("None")),
        PATTERN_DATA: F.lit(data_name),
        PATTERN_COLUMN: F.lit(bind.column),
        PATTERN_AS: F.lit(bind.name),
    }
    parts = []
    for field, percent, literal in re.findall(r"%\((\w+)\)s|(%%)|((?:[^%]|%(?![(%]))+)", bind.pattern):
        if field:
            parts.append(fields[field])
        else:
            parts.append(F.lit("%" if percent else literal))
    return F.concat(*parts)


def bind_parameters(target: DataFrame, binds: Sequence[Bind], data_name: str = "target") -> DataFrame:
    """One row of `applied_*` columns per target row; a missing column fails."""
    missing = [b.column for b in binds if b.column not in target.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {data_name}")
    return target.select(*[pattern_column(b, data_name).alias(f"applied_{b.name}") for b in binds])


def apply_equal(bound: DataFrame, source: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Source rows whose columns equal the bound parameters: {applied name: column}."""
    if not on:
        raise ValueError("apply needs an equality: without one every source row would meet every target row")
    condition = F.lit(True)
    for applied, column in on.items():
        condition = condition & (bound[f"`{applied}`"] == source[f"`{column}`"])
    return source.join(bound, condition)


def apply_within(
    bound: DataFrame,
    source: DataFrame,
    on: Mapping[str, str],
    center: str,
    time_column: str,
    before: int,
    after: int,
) -> DataFrame:
    """Source rows within seconds around the bound time `center`, keys equal."""
    at = as_number(bound, center)
    start, end = at - F.lit(before * 1e6), at + F.lit(after * 1e6)
    width = float(max(before + after, 1)) * 1e6
    joined = range_join(bound, source, list(on.items()), start, end, time_column, width)
    return joined.select(*cols(source.columns), *cols(bound.columns))


def apply_lateral(bound: DataFrame, inputs: Mapping[str, DataFrame], query: str) -> DataFrame:
    """A correlated SELECT per target row, which refers to parameters as `bound.applied_<name>`.

    Equality conditions on parameters become join keys of one plan.
    """
    text = f"SELECT found.*, bound.* FROM bound, LATERAL ({query}) AS found"
    return sql_step(bound.sparkSession, {**inputs, "bound": bound}, text, functions=False)


def unique_output(df: DataFrame, fields: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Optional clean-up of repeated results, first one kept."""
    return first_per_key(df, fields, order_by) if fields else df
