"""Grouping sets from groups: rows are aggregated once, at the finest level, and coarser sets from those groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols

# What a group keeps of its rows, and how groups are put together.
PARTS = {"size": F.sum, "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
FIRST = {"size": lambda c: F.count(F.lit(1)), "count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets, the largest first."""
    return [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def grouping_lattice(
    df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Mapping[str, tuple[str, str]], level: str = "grouping_id"
) -> DataFrame:
    """One row per group of every set: the keys (null where the set has no such key), `level`, the aggregates.

    `aggregates` are {name: (function, column)} with size, count, sum, min, max and mean: what can be put together from
    parts. `level` has a bit for every key, the first the highest, that is 1 where the key is not in the set; it tells a
    missing key from a null in the data, which is a group. A plain GROUP BY of grouping sets copies every row once per
    set; here the copies are made of the finest groups. Sets are each returned once; an empty table has no groups, in no set.
    """
    sets = list(dict.fromkeys(tuple(k for k in keys if k in set(s)) for s in sets))
    finest = [k for k in keys if any(k in s for s in sets)]
    parts: dict[str, tuple[str, str]] = {}
    for fn, column in aggregates.values():
        if fn not in PARTS and fn != "mean":
            raise ValueError(f"{fn} cannot be put together from parts; known: {sorted([*PARTS, 'mean'])}")
        for part in ("sum", "count") if fn == "mean" else (fn,):
            parts[f"__{part}_{column}"] = (part, column)
    groups = df.groupBy(*cols(finest)).agg(*[FIRST[fn](col(c)).alias(n) for n, (fn, c) in parts.items()])

    def whole(fn: str, column: str) -> Column:
        if fn == "mean":
            return F.sum(col(f"__sum_{column}")) / F.sum(col(f"__count_{column}"))
        return PARTS[fn](col(f"__{fn}_{column}"))

    missing = sum((F.grouping(col(k)).cast("long") * F.lit(1 << (len(keys) - 1 - keys.index(k))) for k in finest), F.lit(0).cast("long"))
    unused = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in finest)
    found = groups.groupingSets([[col(k) for k in s] for s in sets], *cols(finest)) if finest else groups.groupBy()
    out = [whole(fn, c).alias(n) for n, (fn, c) in aggregates.items()]
    if not finest:
        rolled = found.agg(F.lit(unused).cast("long").alias(level), F.count(F.lit(1)).alias("__n"), *out).where("__n > 0").drop("__n")
    else:
        rolled = found.agg((missing + F.lit(unused)).alias(level), *out)
    return rolled.select(*[col(k) if k in finest else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], level, *aggregates)
