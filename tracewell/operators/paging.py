"""Pages far down an ordered list: the two cut rows are found by counting, and the page is a filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.sampling import _has_map

PIVOTS = 63  # rows that cut a part of the list, drawn at random
FEW_ROWS = 100_000  # rows of a part that one task orders


@dataclass
class _List:
    """A table as a list by `__o`, a struct that tells rows apart.

    `known` are cuts by the number of rows before them: right before a place, or right after all rows of it.
    """

    df: DataFrame
    descending: bool
    total: int
    few: int
    known: dict[int, tuple[Row, bool]] = field(default_factory=dict)
    passes: int = 0

    def place(self, row: Row) -> Column:
        fields = self.df.schema["__o"].dataType.fields
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)])

    def before(self, row: Row) -> Column:
        return F.col("__o") > self.place(row) if self.descending else F.col("__o") < self.place(row)

    def left_of(self, cut: tuple[Row, bool]) -> Column:
        row, after = cut
        return self.before(row) | (F.col("__o") == self.place(row)) if after else self.before(row)

    def part(self, low: tuple[Row, bool] | None, high: tuple[Row, bool] | None) -> DataFrame:
        found = self.df if low is None else self.df.where(~self.left_of(low))
        return found if high is None else found.where(self.left_of(high))

    def sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("__o").desc() if self.descending else F.col("__o").asc())

    def cut(self, rank: int) -> tuple[Row, int]:
        """The place of the row of this rank (from 0), and how many rows come before that place."""
        while True:
            below = max((r for r in self.known if r <= rank), default=None)
            above = min((r for r in self.known if r > rank), default=None)
            low, high = self.known.get(below), self.known.get(above)
            first, last = below or 0, self.total if above is None else above
            part = self.part(low, high)
            self.passes += 1
            if last - first <= self.few:
                row = self.sorted(part.select("__o")).offset(rank - first).limit(1).first()["__o"]
                return row, first + part.where(self.before(row)).count()
            drawn = part.select("__o").orderBy(F.rand(self.passes)).limit(PIVOTS)
            pivots = [r["__o"] for r in self.sorted(drawn.distinct()).collect()]
            # Even numbers: between two pivots; odd ones: the rows at a pivot.
            counts = {r["at"]: r["n"] for r in part.groupBy(self._search(pivots, 0, len(pivots)).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
            seen = first
            for i, pivot in enumerate(pivots):
                seen += counts.get(2 * i, 0)
                here = counts.get(2 * i + 1, 0)
                if seen <= rank < seen + here:
                    return pivot, seen
                self.known[seen] = (pivot, False)
                seen += here
                self.known[seen] = (pivot, True)

    def _search(self, pivots: list[Row], low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        at = F.when(F.col("__o") == self.place(pivots[middle]), F.lit(2 * middle + 1))
        return at.when(self.before(pivots[middle]), self._search(pivots, low, middle)).otherwise(self._search(pivots, middle + 1, high))


def deep_page(df: DataFrame, by: Sequence[str], rows: int, offset: int = 0, descending: bool = True, few: int = FEW_ROWS) -> DataFrame:
    """`rows` rows from the `offset`-th on of the list by `by`, newest first: what orderBy, offset and limit give.

    The first and the last row of the page are found by counting: at most PIVOTS random rows of the part that holds the
    wanted rank are its cut points, rows between them are counted, and the part shrinks by their number with each pass,
    until one task can order it. The rest is a filter; only the page itself is sorted. Nulls come last (first, if
    ascending). Rows of equal place go by a hash of all their columns, so pages of one list never share or miss a row;
    map columns are not part of it.
    """
    plain = cols(f.name for f in df.schema.fields if not _has_map(f.dataType))
    whole = df.withColumn("__o", F.struct(*[col(n).alias(f"f{i}") for i, n in enumerate(by)], F.xxhash64(*plain).alias("tie")))
    total = df.count()
    first, last = max(0, offset), min(total, offset + rows)
    if first >= last:
        return df.limit(0)
    listed = _List(whole, descending, total, few)
    start, before_start = listed.cut(first)
    end, before_end = listed.cut(last - 1)
    inside = whole.where(~listed.before(start) & (F.col("__o") != listed.place(start)) & listed.before(end))
    # Equal places are equal rows: any of them will do.
    if start == end:
        parts = [whole.where(F.col("__o") == listed.place(start)).limit(last - first)]
    else:
        same = whole.where(F.col("__o") == listed.place(start))
        parts = [inside, same.limit(same.count() - (first - before_start)), whole.where(F.col("__o") == listed.place(end)).limit(last - before_end)]
    return listed.sorted(reduce(DataFrame.unionByName, parts)).select(*cols(df.columns))
