"""Ordered operators that do not need one task per group.

A plain window puts a whole group into one task. Here group sizes are checked
first. While the largest fits a task, a plain window runs. Otherwise the groups
over the limit are cut into slices at quantiles of their order column, the
window runs per (group, slice), and what a slice needs from the slices before it
is carried over from a small summary: one row (or `n` rows) per group and slice.
Groups under the limit stay whole. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import attach, col, cols, dtype, quote
from tracewell.session import cut_lineage
from tracewell.session import rows_per_task as session_rows_per_task

SLICE = "__slice"
HOT = "__hot"
HALO = "__halo"
MAX_SLICES = 4096
# Lists up to these lengths are broadcast: cut groups, and their slices. Longer ones are joined.
FEW_GROUPS = 10_000
FEW_ROWS = 500_000


@dataclass(frozen=True)
class Slices:
    """Ascending cut points of the order column; none means that nothing is cut.

    `hot` lists the groups that are cut; it is broadcast up to FEW_GROUPS of them.
    Without keys the whole table is the one group.
    """

    bounds: tuple[float, ...] = ()
    hot: DataFrame | None = None
    groups: int | None = None

    @property
    def split(self) -> bool:
        return len(self.bounds) > 0

    @property
    def few(self) -> bool:
        """The summary has one row per cut group and slice: is it short?"""
        return self.groups is not None and self.groups * (len(self.bounds) + 2) <= FEW_ROWS


def as_number(df: DataFrame, name: str) -> Column:
    """A monotone number for an order column."""
    kind = dtype(df, name)
    if isinstance(kind, T.NumericType):
        return col(name).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        epoch = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quote(name)})"
        return F.expr(epoch).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double")
    raise TypeError(f"cannot slice on {name} of type {kind.simpleString()}: order by a number or a time first")


def plan_slices(
    df: DataFrame, keys: Sequence[str], order_column: str, rows_per_task: int | None = None
) -> Slices:
    """Find the groups over the limit; cut points come from their rows only.

    One counting pass, with partial counts before the shuffle, and two more
    only when something is cut. The driver gets two numbers and at most
    MAX_SLICES cut points.
    """
    limit = rows_per_task or session_rows_per_task(df.sparkSession)
    sizes = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not groups:
        return Slices()
    # The list is used several times, so it is counted once more and kept.
    hot = cut_lineage(sizes.select(*cols(keys))) if keys else None
    wanted = min(MAX_SLICES, -(-rows // limit))
    shares = [i / wanted for i in range(1, wanted)]
    marked = mark_hot(df, keys, Slices((), hot, groups)).where(HOT)
    number = as_number(marked, order_column)
    cuts = marked.select(F.percentile_approx(number, shares, max(10_000, 10 * wanted)).alias("cuts")).first()["cuts"]
    return Slices(tuple(sorted(set(cuts or ()))), hot, groups)


def mark_hot(df: DataFrame, keys: Sequence[str], slices: Slices) -> DataFrame:
    if slices.hot is None:
        return df.withColumn(HOT, F.lit(True))
    short = slices.groups is not None and slices.groups <= FEW_GROUPS
    marked = attach(df, slices.hot.withColumn(HOT, F.lit(True)), keys, small=short)
    return marked.withColumn(HOT, F.coalesce(HOT, F.lit(False)))


def add_slices(df: DataFrame, keys: Sequence[str], order_column: str, slices: Slices) -> DataFrame:
    """Add HOT and SLICE: found by binary search over the cut points, -1 for nulls, 0 in whole groups."""
    marked = mark_hot(df, keys, slices)
    number = as_number(marked, order_column)
    # One literal that is searched in steps: a tree of comparisons has as many nodes in every plan as there are cut points.
    bounds = F.split(F.lit(",".join(map(repr, slices.bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(slices.bounds).bit_length()))])

    def search(at: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.get(bounds, place + step - 1) <= at, place + step).otherwise(place))

    # The number is worked out once a row.
    found = F.transform(F.array(number), search)[0] if slices.split else F.lit(0)
    place = F.when(number.isNull(), F.lit(-1)).otherwise(found)
    return marked.withColumn(SLICE, F.when(F.col(HOT), place).otherwise(F.lit(0)))


def ordering(names: Sequence[str], descending: bool = False) -> list[Column]:
    return [c.desc() if descending else c.asc() for c in cols(names)]


def _slice_window(keys: Sequence[str], descending: bool):
    order = F.col(SLICE).desc() if descending else F.col(SLICE).asc()
    return Window.partitionBy(*cols(keys)).orderBy(order)


def with_look_back(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    rows: int,
    slices: Slices,
    descending: bool = False,
) -> DataFrame:
    """Add to every (group, slice) copies of the `rows` rows that precede it.

    Copies have HALO = true. Windows over (keys, SLICE) that look back at most
    `rows` rows are then exact for the rows with HALO = false.
    """
    sliced = add_slices(df, keys, order_by[0], slices)
    inside = Window.partitionBy(*cols(keys), SLICE).orderBy(*ordering(order_by, not descending))
    tails = (
        sliced.where(HOT)
        .withColumn("__back", F.row_number().over(inside))
        .where(F.col("__back") <= rows)
        .groupBy(*cols(keys), SLICE)
        .agg(F.collect_list(F.struct(F.col("__back"), F.struct(*cols(df.columns)).alias("row"))).alias("tail"))
    )
    # A slice that is present holds at least one row, so the rows wanted are in
    # the `rows` slices before it: the frame is bounded.
    before = _slice_window(keys, descending).rowsBetween(-rows, -1)
    gathered = tails.select(*cols(keys), SLICE, F.collect_list(F.struct(SLICE, "tail")).over(before).alias("parts"))
    # Nearest first: later slices first, inside a slice by distance from its end.
    place = F.col("part")[SLICE] if descending else -F.col("part")[SLICE]
    nearest = Window.partitionBy(*cols(keys), SLICE).orderBy("__place", "__back")
    halo = (
        gathered.select(*cols(keys), SLICE, F.explode("parts").alias("part"))
        .select(*cols(keys), SLICE, place.alias("__place"), F.inline(F.col("part")["tail"]))
        .withColumn("__near", F.row_number().over(nearest))
        .where(F.col("__near") <= rows)
        .select(*[F.col("row").getField(n).alias(n) for n in df.columns], SLICE, F.lit(True).alias(HALO))
    )
    return sliced.select(*cols(df.columns), SLICE, F.lit(False).alias(HALO)).unionByName(halo)


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


# Aggregates that can be put together from parts, and how.
COMBINE = {"sum": _add, "count": _add, "min": F.least, "max": F.greatest}
AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
OVER_PARTS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    aggregates: dict[str, tuple[str, Column]],
    descending: bool = False,
    rows_per_task: int | None = None,
    peers: bool = False,
    slices: Slices | None = None,
) -> DataFrame:
    """Running aggregates {name: (sum, count, min or max, value)}, current row included.

    `order_by` must decide ties, unless `peers` takes in all rows of equal place.
    `slices` may be planned beforehand, from the table the rows come from.
    """
    slices = plan_slices(df, keys, order_by[0], rows_per_task) if slices is None else slices
    order = ordering(order_by, descending)

    def up_to_here(*partition: Column | str):
        window = Window.partitionBy(*partition).orderBy(*order)
        frame = window.rangeBetween if peers else window.rowsBetween
        return frame(Window.unboundedPreceding, Window.currentRow)

    if not slices.split:
        window = up_to_here(*cols(keys))
        return df.select("*", *[AGGREGATE[fn](value).over(window).alias(n) for n, (fn, value) in aggregates.items()])

    sliced = add_slices(df, keys, order_by[0], slices)
    parts = sliced.where(HOT).groupBy(*cols(keys), SLICE).agg(
        *[AGGREGATE[fn](value).alias(f"__part_{n}") for n, (fn, value) in aggregates.items()]
    )
    before = _slice_window(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *cols(keys),
        SLICE,
        *[OVER_PARTS[fn](f"__part_{n}").over(before).alias(f"__carry_{n}") for n, (fn, _) in aggregates.items()],
    )
    window = up_to_here(*cols(keys), SLICE)
    local = sliced.select(
        "*", *[AGGREGATE[fn](value).over(window).alias(f"__local_{n}") for n, (fn, value) in aggregates.items()]
    )
    return attach(local, carried, [*keys, SLICE], small=slices.few).select(
        *cols(df.columns),
        *[COMBINE[fn](F.col(f"__local_{n}"), F.col(f"__carry_{n}")).alias(n) for n, (fn, _) in aggregates.items()],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    totals: dict[str, Column],
    descending: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Running sums, current row included. `order_by` must decide ties."""
    sums = {name: ("sum", value) for name, value in totals.items()}
    return running(df, keys, order_by, sums, descending, rows_per_task)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    values: dict[str, Column],
    rows_per_task: int | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Last non-null value at or before each row, for every named expression.

    `slices` may be planned beforehand, from the table the rows come from.
    """
    slices = plan_slices(df, keys, order_by[0], rows_per_task) if slices is None else slices
    order = ordering(order_by)
    if not slices.split:
        window = Window.partitionBy(*cols(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.last(v, ignorenulls=True).over(window).alias(n) for n, v in values.items()])

    sliced = add_slices(df, keys, order_by[0], slices)
    position = F.struct(*cols(order_by))
    lasts = sliced.where(HOT).groupBy(*cols(keys), SLICE).agg(
        *[F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__last_{n}") for n, v in values.items()]
    )
    before = _slice_window(keys, False).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *cols(keys),
        SLICE,
        *[F.last(f"__last_{n}", ignorenulls=True).over(before).alias(f"__carry_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*cols(keys), SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.select(
        "*", *[F.last(v, ignorenulls=True).over(inside).alias(f"__local_{n}") for n, v in values.items()]
    )
    return attach(local, carried, [*keys, SLICE], small=slices.few).select(
        *cols(df.columns),
        *[F.coalesce(F.col(f"__local_{n}"), F.col(f"__carry_{n}")).alias(n) for n in values],
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str = "row_number",
    descending: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """row_number() as a running count."""
    return running_totals(df, keys, order_by, {name: F.lit(1).cast("long")}, descending, rows_per_task)


def _placed(counted: DataFrame, keys: Sequence[str], by: str, descending: bool, rows_per_task: int | None) -> DataFrame:
    """Counted values (`__n` rows each) with rows and values so far, and the group's rows."""
    slices = plan_slices(counted, keys, by, rows_per_task)
    so_far = {"__seen": ("sum", F.col("__n")), "__values": ("count", F.lit(1))}
    placed = running(counted, keys, [by], so_far, descending, slices=slices)
    if not slices.split:
        # The same partitioning serves the group's total.
        return placed.withColumn("group_rows", F.sum("__n").over(Window.partitionBy(*cols(keys))))
    sizes = counted.groupBy(*cols(keys)).agg(F.sum("__n").alias("group_rows"))
    return attach(placed, sizes, keys, "inner")


def rank_values(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    descending: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Rank of every distinct value of `by` in its group.

    Rows are first counted per (group, value) on the map side, so ties, however
    many, are one row. Columns: keys, by, rank, dense_rank, percent_rank,
    cume_dist, group_rows. Join it back on (keys, by) to rank rows.
    """
    counted = df.groupBy(*cols(keys), col(by)).agg(F.count(F.lit(1)).alias("__n"))
    placed = _placed(counted, keys, by, descending, rows_per_task)
    rank = F.col("__seen") - F.col("__n") + 1
    return placed.select(
        *cols(keys),
        col(by),
        rank.alias("rank"),
        F.col("__values").alias("dense_rank"),
        F.when(F.col("group_rows") > 1, (rank - 1) / (F.col("group_rows") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        (F.col("__seen") / F.col("group_rows")).alias("cume_dist"),
        F.col("group_rows"),
    )


RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    ties: Sequence[str],
    tiles: int | None = None,
    descending: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add the RANKS by `by`, and `ntile` when `tiles` is given.

    `ties` order rows of equal rank for row_number and ntile. One window when
    all groups fit a task; otherwise numbers come from slices and ranks from
    counted values.
    """
    slices = plan_slices(df, keys, by, rows_per_task)
    if not slices.split:
        group = Window.partitionBy(*cols(keys))
        loose, strict = group.orderBy(*ordering([by], descending)), group.orderBy(*ordering([by, *ties], descending))
        out = df.select(
            "*",
            F.row_number().over(strict).cast("long").alias("row_number"),
            F.rank().over(loose).cast("long").alias("rank"),
            F.dense_rank().over(loose).cast("long").alias("dense_rank"),
            F.percent_rank().over(loose).alias("percent_rank"),
            F.cume_dist().over(loose).alias("cume_dist"),
        )
        return out if tiles is None else out.withColumn("ntile", F.ntile(tiles).over(strict).cast("long"))
    numbered = running(df, keys, [by, *ties], {"row_number": ("count", F.lit(1))}, descending, slices=slices)
    out = attach(numbered, rank_values(df, keys, by, descending, rows_per_task), [*keys, by], "inner")
    if tiles is not None:
        # The first (rows mod tiles) tiles hold one row more than the others.
        place, small, extra = F.col("row_number") - 1, F.expr(f"group_rows div {tiles}"), F.col("group_rows") % tiles
        in_large = F.floor(place / (small + 1))
        in_small = extra + F.floor((place - extra * (small + 1)) / F.greatest(small, F.lit(1)))
        out = out.withColumn("ntile", F.when(place < extra * (small + 1), in_large).otherwise(in_small) + 1)
    return out.drop("group_rows")


def median_values(
    df: DataFrame, keys: Sequence[str], column: str, name: str, rows_per_task: int | None = None
) -> DataFrame:
    """Exact median per group from counted values; nulls are left out."""
    counted = (
        df.where(col(column).isNotNull()).groupBy(*cols(keys), col(column)).agg(F.count(F.lit(1)).alias("__n"))
    )
    placed = _placed(counted, keys, column, False, rows_per_task)
    first = F.col("__seen") - F.col("__n") + 1
    low, high = F.expr("(group_rows + 1) div 2"), F.expr("(group_rows + 2) div 2")
    joined = placed.select(
        *cols(keys),
        col(column).cast("double").alias("__v"),
        F.when((first <= low) & (low <= F.col("__seen")), 1).otherwise(0).alias("__low"),
        F.when((first <= high) & (high <= F.col("__seen")), 1).otherwise(0).alias("__high"),
    )
    middle = joined.where((F.col("__low") == 1) | (F.col("__high") == 1))
    return middle.groupBy(*cols(keys)).agg(
        (F.sum(F.col("__v") * (F.col("__low") + F.col("__high"))) / 2).alias(name)
    )


def moving_range(
    df: DataFrame,
    keys: Sequence[str],
    time_column: str,
    seconds: int,
    aggregates: dict[str, tuple[str, Column]],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Aggregates over the `seconds` before each row, both ends and equal times included.

    Time is cut into spans as long as the frame, so a frame is the end of one
    span and the beginning of the next: two running aggregates, one forward and
    one backward, whatever the number of rows in a frame. The backward one is
    read off at markers placed one frame length before each row.
    """
    width = seconds * 1_000_000
    values = {f"__v_{n}": value for n, (_, value) in aggregates.items()}
    base = df.withColumn("__at", as_number(df, time_column).cast("long")).withColumns(values)
    base = base.withColumn("__span", F.floor(F.col("__at") / F.lit(width)))
    places = F.array(
        F.struct(F.col("__span").alias("span"), F.col("__at").alias("at")),
        F.struct((F.col("__span") - 1).alias("span"), (F.col("__at") - width).alias("at")),
    )
    rows_and_markers = base.select(*cols(keys), F.inline(places)).withColumnsRenamed({"span": "__span", "at": "__at"})
    groups = [*keys, "__span"]
    slices = plan_slices(rows_and_markers, groups, "__at", rows_per_task)

    forward = {f"__f_{n}": (fn, F.col(f"__v_{n}")) for n, (fn, _) in aggregates.items()}
    begun = running(base, groups, ["__at"], forward, peers=True, slices=slices)
    rows = base.select(*cols(groups), "__at", F.lit(1).alias("__side"), *values)
    markers = begun.select(
        *cols(keys), (F.col("__span") - 1).alias("__span"), (F.col("__at") - width).alias("__at"), F.lit(0).alias("__side"),
        F.struct(*cols(df.columns), *forward).alias("__row"),
    )
    backward = {n: (fn, F.col(f"__v_{n}")) for n, (fn, _) in aggregates.items()}
    both = rows.unionByName(markers, allowMissingColumns=True)
    ended = running(both, groups, ["__at", "__side"], backward, descending=True, slices=slices)

    def whole(name: str, fn: str) -> Column:
        begin = F.col("__row").getField(f"__f_{name}")
        return F.when(F.col("__at").isNull(), begin).otherwise(COMBINE[fn](begin, col(name)))

    return ended.where(F.col("__side") == 0).select(
        *[F.col("__row").getField(n).alias(n) for n in df.columns],
        *[whole(n, fn).alias(n) for n, (fn, _) in aggregates.items()],
    )
