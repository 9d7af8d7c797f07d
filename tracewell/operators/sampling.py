"""Random samples of an exact size that do not depend on how rows are partitioned.

Rows are ordered by a hash of their key, and the first ones are the sample: the
bottom-k rule. Hashes are even, so a threshold a little over the wanted share
leaves about the sample, found where the rows are; only these few are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import attach, col, cols
from tracewell.operators.ordered import FEW_GROUPS, number_rows
from tracewell.session import cut_lineage

SPARE = 6.0  # deviations that the threshold lies above the wanted share


def sample_order(keys: Sequence[str], seed: int) -> Column:
    """The text that decides: the MD5 of the seed and the key columns as text, joined by |; null keys are left out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, rows: int, keys: Sequence[str], seed: int = 0, rows_per_task: int | None = None) -> DataFrame:
    """`rows` random rows, all if there are fewer; the same ones for the same keys and seed, however the table is cut.

    `keys` should tell rows apart. Rows of one key have one chance; where only some of them fit, the hash of the whole
    row decides. Samples of one seed are nested: a smaller one is part of a larger one.
    """
    return sample_strata(df, [], rows, keys, seed, rows_per_task)


def sample_strata(
    df: DataFrame, strata: Sequence[str], size: int | float, keys: Sequence[str], seed: int = 0, rows_per_task: int | None = None
) -> DataFrame:
    """So many random rows of every stratum: `size` of them (all, if there are fewer), or a share of it below 1, rounded up.

    Null is a stratum of its own. Otherwise as sample_rows.
    """
    if size < 0:
        raise ValueError("a sample cannot have a negative size")
    counts = df.groupBy(*cols(strata)).agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.ceil(F.col("__n") * F.lit(float(size))) if isinstance(size, float) and size < 1 else F.least(F.col("__n"), F.lit(int(size)).cast("long"))
    counts = cut_lineage(counts.withColumn("__wanted", wanted.cast("long")).where("__wanted > 0"))
    groups = counts.count()
    text = sample_order(keys, seed)
    number = F.conv(F.substring("__text", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    plain = [c for c in cols(f.name for f in df.schema.fields if not _has_map(f.dataType))]
    marked = df.withColumn("__text", text).withColumn("__u", number).withColumn("__tie", F.xxhash64(*plain))
    factor = 1.0
    while True:
        spare = F.col("__wanted") + SPARE * F.sqrt("__wanted") + 16
        limits = counts.withColumn("__below", F.lit(factor) * spare / F.col("__n"))
        if strata:
            # Many rows of few strata stay where they are.
            near = attach(marked, limits, strata, small=groups <= FEW_GROUPS)
        else:  # one row, or none
            one = limits.first() or {"__wanted": 0, "__below": 0.0}
            near = marked.withColumns({n: F.lit(one[n]) for n in ("__wanted", "__below")})
        near = cut_lineage(near.where(F.col("__u") < F.col("__below")))
        found = near.groupBy(*cols(strata), "__wanted").agg(F.count(F.lit(1)).alias("__found"))
        held = found.agg(F.count_if(F.col("__found") >= F.col("__wanted"))).first()[0]
        if held == groups:
            break
        factor *= 4  # a stratum whose hashes happen to lie high, or whose rows share few keys
    order = ["__u", "__text", "__tie"]
    return number_rows(near, strata, order, "__place", rows_per_task=rows_per_task).where(F.col("__place") <= F.col("__wanted")).select(*cols(df.columns))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)
