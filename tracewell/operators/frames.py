"""Medians, quantiles and distinct counts over moving frames of any length.

These cannot be put together from the parts of a frame, so a window works on
every frame anew. Here the rows of a group are cut into slices of consecutive
places, and their codes (the rank of a value, or the place of the last equal one)
into ranges of the same size. Frames that start in one slice and end in another
have all slices between in common. Of these a small table of counts per slice and
range of codes tells which rows can matter: those of the few ranges in which a
quantile of such a frame can lie, or those whose last equal value lies in the first
slice; the others are only counted. A task takes such frames and their rows, a few
times a slice, and goes down a wavelet tree of them in arrays: no frame and no
group has to fit a task, and each row is read by a few tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.ordered import as_number, rank_values, running
from tracewell.operators.ranges import asof_join
from tracewell.operators.shift import shift
from tracewell.session import cut_lineage, write_and_read
from tracewell.session import rows_per_task as session_rows_per_task

SLICE_ROWS = 50_000  # rows of a slice, unless a group has more than
MOST_SLICES = 2_000  # of them
UNIT = ["__id", "__k", "__sa", "__sb", "__sp"]  # group, result, slices of the frames' starts, ends and own rows


@dataclass(frozen=True)
class Frame:
    """From `preceding` before a row to `following` after it, None without an end.

    Counted in rows, or with `by_value` in units of the order column
    (microseconds for times, days for dates), where rows of equal place count as one.
    """

    preceding: int | None = 0
    following: int | None = 0
    by_value: bool = False


@dataclass(frozen=True)
class Quantile:
    column: str
    frame: Frame
    share: float = 0.5


@dataclass(frozen=True)
class Distinct:
    column: str
    frame: Frame


def moving_holistic(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], results: Mapping[str, Quantile | Distinct], rows_per_task: int | None = None
) -> DataFrame:
    """Add the results over a frame around every row of its group.

    `order_by` must decide ties; with `by_value` its first column is a whole
    number or a time. Nulls are left out of frames; a quantile of no value is null,
    a distinct count 0. Quantiles lie between two values as in quantile_cont. Rows
    without a place (a null first order column) have no frame by value, and are in
    none. Null keys are a group. Values of quantiles are numbers.
    """
    group = F.to_json(F.struct(*cols(keys))) if keys else F.lit("")
    at = as_number(df, order_by[0]).cast("long") if any(r.frame.by_value for r in results.values()) else F.lit(None).cast("long")
    base = df.withColumn("__g", group).withColumn("__at", at)
    placed = cut_lineage(running(base, ["__g"], order_by, {"__p": ("count", F.lit(1))}, rows_per_task=rows_per_task))
    groups = placed.groupBy("__g").agg(F.max("__p").alias("__n"), F.count("__at").alias("__timed"))
    groups = write_and_read(groups.withColumn("__id", F.monotonically_increasing_id()), "frame-groups")
    total, longest = groups.agg(F.sum("__n"), F.max("__n")).first()
    size = max(min(SLICE_ROWS, rows_per_task or session_rows_per_task(df.sparkSession)), -(-(longest or 0) // MOST_SLICES))
    columns = sorted({r.column for r in results.values()})
    held = {c: f"__c{i}" for i, c in enumerate(columns)}
    rows = placed.join(groups, "__g").select("__id", "__p", "__n", "__timed", "__at", *[col(c).alias(n) for c, n in held.items()])
    rows = write_and_read(rows, "frame-rows")
    names = list(results)
    answers = []
    for kind, column in sorted({(type(r).__name__, r.column) for r in results.values()}):
        wanted = {k: results[n] for k, n in enumerate(names) if (type(results[n]).__name__, results[n].column) == (kind, column)}
        there = rows.where(col(held[column]).isNotNull()).select("__id", "__p", col(held[column]).alias("__value"))
        codes = (_value_codes if kind == "Quantile" else _last_codes)(there, rows_per_task)
        slices = {"__ps": F.floor((F.col("__p") - 1) / size), "__cs": F.floor((F.col("__code") - 1) / size)}
        data = write_and_read(codes.withColumns(slices), "frame-codes")
        asked = reduce(DataFrame.unionByName, [_frames(rows, k, r.frame, size, rows_per_task) for k, r in wanted.items()])
        shares = {k: r.share for k, r in wanted.items()} if kind == "Quantile" else None
        tasks = max(1, -(-2 * (total or 0) * len(wanted) // size))
        answers.append(_answered(write_and_read(asked, "frames"), data, shares, (longest or 0) > 2 * size, tasks))
    pick = {n: F.max(F.when(F.col("__k") == k, F.col("v" if isinstance(r, Quantile) else "n"))) for k, (n, r) in enumerate(results.items())}
    found = reduce(DataFrame.unionByName, answers).groupBy("__id", "__p").agg(*[c.alias(f"__r{k}") for k, c in enumerate(pick.values())])
    out = placed.join(groups.select("__g", "__id"), "__g").join(found, ["__id", "__p"], "left")
    values = {n: F.col(f"__r{k}") if isinstance(r, Quantile) else F.coalesce(f"__r{k}", F.lit(0).cast("long")) for k, (n, r) in enumerate(results.items())}
    return out.select(*cols(df.columns), *[c.alias(n) for n, c in values.items()])


def _value_codes(values: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Place of every value in the order of its group's values, equal ones by place of the row."""
    ranks = rank_values(values, ["__id"], "__value", rows_per_task=rows_per_task).select("__id", "__value", "rank")
    among = running(values, ["__id", "__value"], ["__p"], {"__among": ("count", F.lit(1))}, rows_per_task=rows_per_task)
    code = F.col("rank") + F.col("__among") - 1
    return among.join(ranks, ["__id", "__value"]).select("__id", "__p", code.cast("long").alias("__code"), F.col("__value").cast("double").alias("v"))


def _last_codes(values: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Place of the last equal value, 0 for the first: a frame that starts behind it counts the value here."""
    last = shift(values.withColumn("__last", F.col("__p")), ["__id", "__value"], "__last", "__code", 1, ["__p"], 0, rows_per_task=rows_per_task)
    return last.select("__id", "__p", F.col("__code").cast("long").alias("__code"), F.lit(None).cast("double").alias("v"))


def _frames(rows: DataFrame, number: int, frame: Frame, size: int, rows_per_task: int | None) -> DataFrame:
    """(unit, p, a, b): the frame of row p holds the rows a + 1 .. b of its group; empty ones are left out.

    Groups of more than two slices: a frame from the first row on has no first slice (-1), and one up to the last no last.
    """
    n, first = F.col("__n"), F.lit(0).cast("long")
    here = F.col("__at") if frame.by_value else F.col("__p")
    if frame.by_value:
        first = n - F.col("__timed")  # rows without a place come first
        rows = rows.where(F.col("__at").isNotNull())
        marks = rows.select("__id", F.col("__at").alias("__mark"), F.col("__p").alias("__tie"), F.col("__p").alias("__found"))
    rows = rows.select("__id", "__p", "__n", "__timed", "__at")

    def up_to(to: DataFrame, place: Column, name: str) -> DataFrame:
        if not frame.by_value:
            return to.withColumn(name, place)
        found = asof_join(to.withColumn("__probe", place), marks, ["__id"], "__probe", "__mark", ["__found"], "__tie", rows_per_task)
        return found.withColumn(name, F.coalesce("__found", first)).drop("__probe", "__found")

    rows = rows.withColumn("a", first) if frame.preceding is None else up_to(rows, here - frame.preceding - 1, "a")
    rows = rows.withColumn("b", n) if frame.following is None else up_to(rows, here + frame.following, "b")
    rows = rows.withColumns({"a": F.greatest("a", first), "b": F.least("b", n)}).where("b > a")
    long = n > 2 * size
    start = F.when(long & (F.col("a") == 0), F.lit(-1)).otherwise(F.floor(F.col("a") / size))
    end = F.when(long & (F.col("b") == n), F.floor((n - 1) / size) + 1).otherwise(F.floor((F.col("b") - 1) / size))
    own = F.floor((F.col("__p") - 1) / size)
    parts = [F.lit(number).cast("long"), start, end, own]
    return rows.select("__id", *[c.cast("long").alias(u) for u, c in zip(UNIT[1:], parts)], "__p", "a", "b")


def _answered(asked: DataFrame, data: DataFrame, shares: Mapping[int, float] | None, far: bool, tasks: int) -> DataFrame:
    """(id, k, p, v, n) of the frames: quantiles by `shares` of the results in `v`, or distinct counts in `n`."""
    units = write_and_read(asked.select(*UNIT).distinct(), "frame-units")
    spans = ["__id", "__k", "__sa", "__sb"]
    at_ends = units.withColumn("__ps", F.explode(F.array_distinct(F.array("__sa", "__sb")))).join(data, ["__id", "__ps"])
    rows = at_ends.select(*UNIT, "__p", "__code", "v")
    asked = asked.withColumns({"base": F.lit(0).cast("long"), "rest": F.lit(0).cast("long")})
    if far:
        between = units.where("__sb - __sa >= 2").select(*spans).distinct()
        counts = data.join(between.select("__id").distinct(), "__id", "left_semi").groupBy("__id", "__ps", "__cs").agg(F.count("*").alias("c"))
        kinds = "__id long, __k long, __sa long, __sb long, low long, high long, base long, rest long"
        cores = write_and_read(between.groupBy("__id").cogroup(counts.groupBy("__id")).applyInArrow(_ranges_between(shares), kinds), "frame-cores")
        cells = cores.where("low <= high").withColumn("__ps", F.explode(F.sequence(F.col("__sa") + 1, F.col("__sb") - 1)))
        cells = cells.withColumn("__cs", F.explode(F.sequence("low", "high"))).select(*spans, "__ps", "__cs")
        inside = units.join(cells, spans).join(data, ["__id", "__ps", "__cs"])
        rows = rows.unionByName(inside.select(*UNIT, "__p", "__code", "v"))
        asked = asked.drop("base", "rest").join(cores.select(*spans, "base", "rest"), spans, "left").fillna(0, ["base", "rest"])
    task = F.pmod(F.xxhash64(*UNIT), F.lit(tasks)).alias("task")
    order = [*UNIT, "__p"]
    return (
        asked.select(*order, "a", "b", "base", "rest").groupBy(task).cogroup(rows.select(*order, "__code", "v").groupBy(task))
        .applyInArrow(_of_units(shares), "__id long, __k long, __p long, v double, n long")
    )


def _ranges_between(shares: Mapping[int, float] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of frames with the same first and last slice: ranges of codes (low..high) whose rows between matter, how many
    rows lie below (`base`), and how many are not read in all (`rest`)."""

    def run(spans: pa.Table, counts: pa.Table) -> pa.Table:
        if not spans.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("__id", "__k", "__sa", "__sb", "low", "high", "base", "rest")})
        place, code, count = (counts.column(n).to_numpy() for n in ("__ps", "__cs", "c"))
        ends = spans.column("__sb").to_numpy()
        table = np.zeros((max(int(ends.max()), int(place.max(initial=-1)) + 1) + 2, int(code.max(initial=-1)) + 2), np.int64)
        np.add.at(table, (place + 1, code + 1), count)
        whole = table.sum(axis=1)  # of slice s at s + 1; none has no first slice
        before = table.cumsum(axis=0)  # row s: slices below s
        found = []
        for k, start, end in zip(spans.column("__k").to_pylist(), spans.column("__sa").to_pylist(), ends.tolist()):
            inside = before[end] - before[start + 1]
            below = inside.cumsum()
            if shares is None:
                # Codes of earlier slices lie before the frame's start, those of later ones never do.
                base = int(below[min(max(start, 0), len(below) - 1)])
                found.append((start, start, base, 0) if start >= 0 else (0, -1, base, 0))
                continue
            known, at_ends = int(below[-1]), int(whole[start + 1] + whole[end + 1])
            least = max(0, int(np.floor(shares[k] * max(known - 1, 0))) - at_ends)
            most = int(np.ceil(shares[k] * max(known + at_ends - 1, 0)))
            low, high = (int(np.searchsorted(below, x, "right")) for x in (least, most))
            high = min(high, len(below) - 1)
            base = int(below[min(low, len(below)) - 1]) if low else 0
            read = int(below[high]) - base if low <= high else 0
            found.append((low - 1, high - 1, base, known - read))
        columns = dict(zip(("low", "high", "base", "rest"), np.array(found, np.int64).T))
        return pa.table({**{n: spans.column(n) for n in ("__id", "__k", "__sa", "__sb")}, **{n: pa.array(c) for n, c in columns.items()}})

    return run


def _of_units(shares: Mapping[int, float] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ask = {n: asked.column(n).to_numpy() for n in ("__id", "__k", "__p", "a", "b", "base", "rest")}
        row = {n: rows.column(n).to_numpy() for n in ("__p", "__code", "v")}
        of = pd.DataFrame({n: np.concatenate([asked.column(n).to_numpy(), rows.column(n).to_numpy()]) for n in UNIT})
        unit = of.groupby(UNIT, sort=False).ngroup().to_numpy().astype(np.int64)
        unit, owner = unit[: len(ask["a"])], unit[len(ask["a"]) :]
        # The rows of all units one after the other, by place: a frame is a run of them.
        wide = int(max(ask["b"].max(initial=0), row["__p"].max(initial=0))) + 1
        key = owner * wide + row["__p"]
        order = np.argsort(key)
        key, code = key[order], row["__code"][order]
        start, end = (np.searchsorted(key, unit * wide + ask[n], "right") for n in ("a", "b"))
        by_code = np.argsort(code, kind="stable")
        rank = np.empty(len(code), np.int64)
        rank[by_code] = np.arange(len(code))
        if shares is None:
            n = _fewer(rank, start, end, np.searchsorted(code[by_code], ask["a"], "right")) + ask["base"]
            keep, v = n > 0, np.zeros(len(n))
        else:
            count = end - start + ask["rest"]
            keep, n = count > 0, np.zeros(len(count), np.int64)
            place = (count - 1) * np.array([shares[k] for k in ask["__k"].tolist()], dtype=np.float64)
            low, high = np.floor(place)[keep], np.ceil(place)[keep]
            ranked = row["v"][order][by_code]
            first, last = (ranked[_smallest(rank, start[keep], end[keep], x.astype(np.int64) - ask["base"][keep])] for x in (low, high))
            v = np.zeros(len(count))
            v[keep] = first + (last - first) * (place[keep] - low)
        columns = {"__id": ask["__id"], "__k": ask["__k"], "__p": ask["__p"], "v": v, "n": n}
        return pa.table({name: pa.array(c[keep]) for name, c in columns.items()})

    return run


def _levels(rank: np.ndarray):
    """The levels of a wavelet tree of whole numbers below len(rank): (bit, how many up to each place have it not set)."""
    for bit in reversed(range(len(rank).bit_length())):
        ones = (rank >> bit) & 1 == 1
        yield bit, np.concatenate([[0], np.cumsum(~ones)])
        rank = np.concatenate([rank[~ones], rank[ones]])


def _smallest(rank: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest, from 0, of each run of `rank`, a permutation."""
    found = np.zeros(len(start), np.int64)
    for bit, zeros in _levels(rank):
        a, b = zeros[start], zeros[end]
        up = k >= b - a
        found += up.astype(np.int64) << bit
        k = np.where(up, k - (b - a), k)
        start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
    return found


def _fewer(rank: np.ndarray, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of each run of `rank`, a permutation, lie below a limit."""
    found = np.zeros(len(start), np.int64)
    for bit, zeros in _levels(rank):
        a, b = zeros[start], zeros[end]
        up = (limit >> bit) & 1 == 1
        found += np.where(up, b - a, 0)
        start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
    return found
