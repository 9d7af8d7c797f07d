"""Column name helpers. Dotted names such as `process.parent.pid` are flat names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[col(old).alias(new) for old, new in zip(df.columns, names)])


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on equal keys (null equals null), keeping the left key columns once.

    `small` broadcasts the right side: only for sides with a proven bound.
    """
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    other = right.select(*[col(n).alias(renamed.get(n, n)) for n in right.columns])
    condition = F.lit(True)
    for key, name in renamed.items():
        condition = condition & col(key).eqNullSafe(F.col(name))
    return left.join(F.broadcast(other) if small else other, condition, how).drop(*renamed.values())


def to_text(df: DataFrame, name: str) -> Column:
    """Text of any column: nested values as JSON, everything else by cast."""
    if isinstance(dtype(df, name), (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    return col(name).cast("string")


def fill_missing(df: DataFrame, text: str = "-") -> DataFrame:
    """Show missing values as text. Every column that can be null becomes a string."""
    return df.select(*[F.coalesce(to_text(df, n), F.lit(text)).alias(n) for n in df.columns])
