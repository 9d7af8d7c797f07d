"""As-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols, quote
from tracewell.operators.ordered import Slices, as_number, carry_last
from tracewell.session import write_and_read


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    right_columns: Sequence[str],
    right_tie: str | None = None,
    rows_per_task: int | None = None,
    slices: Slices | None = None,
) -> DataFrame:
    """Every left row with the last right row of equal keys at or before its time.

    One union and one ordered pass: linear in both inputs, whatever a key's
    share of the rows. `right_tie` decides between right rows of equal time.
    """
    wanted = F.struct(*cols(right_columns))
    tie = col(right_tie) if right_tie else F.lit(0)
    marks = right.select(
        *cols(on), col(right_time).alias("__t"), F.lit(0).alias("__side"), tie.alias("__tie"), wanted.alias("__r")
    )
    rows = left.select(
        *cols(on), col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols(left.columns)).alias("__l")
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    carried = carry_last(both, on, ["__t", "__side", "__tie"], {"__m": F.col("__r")}, rows_per_task, slices)
    known = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in on], F.lit(True)) & F.col("__t").isNotNull()
    return carried.where(F.col("__side") == 1).select(
        *[F.col("__l").getField(n).alias(n) for n in left.columns],
        *[F.when(known, F.col("__m").getField(n)).alias(n) for n in right_columns],
    )


RADIX_BITS = 4  # a node of one level covers 16 of the level below
FEW_RANGES, MANY_RANGES = 64, 100_000  # keys with so few ranges on one side, and no more on the other, are not cut
FARTHEST = 1 << 58  # cells beyond are one cell: open ends are allowed

# Cells first..last as the fewest nodes of a 16-way tree over the line: of every level the nodes that no larger one covers.
_NODES = """
flatten(transform(sequence(0, greatest(CAST(floor(log2(__last - __first + 1) / {b}) AS INT), 0) + 1), l ->
  transform(array(named_struct(
      'lo', shiftright(__first + shiftleft(1L, {b} * l) - 1, {b} * l), 'hi', shiftright(__last + 1, {b} * l),
      'up', shiftright(__first + shiftleft(1L, {b} * l + {b}) - 1, {b} * l + {b}), 'top', shiftright(__last + 1, {b} * l + {b}))), s ->
    transform(filter(concat(
        if(s.lo < if(s.up < s.top, s.up * {r}, s.hi), sequence(s.lo, if(s.up < s.top, s.up * {r}, s.hi) - 1), array()),
        if(s.up < s.top AND s.top * {r} < s.hi, sequence(s.top * {r}, s.hi - 1), array())), n -> n IS NOT NULL),
      n -> shiftleft(n, 4) + l))[0]))
""".format(b=RADIX_BITS, r=1 << RADIX_BITS)


def _cell(number: Column, width: float) -> Column:
    return F.least(F.greatest(F.floor(number / F.lit(width)), F.lit(-FARTHEST)), F.lit(FARTHEST))


def _stab(ranges: DataFrame, points: DataFrame, on: Sequence[tuple[str, str]], width: float, beyond_start: bool = False) -> DataFrame:
    """Pairs with equal keys and `__point` of the one in `__from`..`__to` of the other.

    The line is cut into cells of `width`. A range is held by the nodes of a
    16-way tree that make up its cells: at most 30 a level, so a number that
    grows with the logarithm of its length. A point asks for its node on every
    level that a range can have. It lies in one node of each range around it, so
    each pair meets once, and all that meets is a pair, but for the end cells.
    """
    whole = ranges.where(F.col("__from") <= F.col("__to")).withColumn("__first", _cell(F.col("__from"), width)).withColumn("__last", _cell(F.col("__to"), width))
    longest = whole.agg(F.max(F.col("__last") - F.col("__first") + 1)).first()[0] or 1
    levels = (int(longest).bit_length() - 1) // RADIX_BITS
    held = whole.withColumn("__node", F.explode(F.expr(_NODES))).drop("__first", "__last")
    node = F.expr(f"shiftleft(shiftright(__cell, {RADIX_BITS} * __level), 4) + __level")
    asked = points.where(F.col("__point").isNotNull()).withColumn("__cell", _cell(F.col("__point"), width))
    asked = asked.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("__at", node).drop("__cell", "__level")
    condition = (F.col("__node") == F.col("__at")) & F.col("__point").between(F.col("__from"), F.col("__to"))
    if beyond_start:
        condition = condition & (F.col("__point") > F.col("__from"))
    for a, b in on:
        condition = condition & (held[quote(a)] == asked[quote(b)])
    return held.join(asked, condition).drop("__from", "__to", "__node", "__point", "__at")


def range_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    start: Column,
    end: Column,
    point: str,
    width: float,
) -> DataFrame:
    """Pairs with equal keys and the right point inside the left range, ends included.

    `start` and `end` are numbers in the units of `point` (microseconds for
    times); null matches nothing, and an infinite end is open. Choose a `width`
    near the usual range length; longer ranges cost the logarithm of their
    length (see _stab), and even one hot key is spread over the line.
    """
    ranges = left.withColumn("__from", start).withColumn("__to", end)
    return _stab(ranges, right.withColumn("__point", as_number(right, point)), on, width)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_range: tuple[Column, Column],
    right_range: tuple[Column, Column],
    width: float,
) -> DataFrame:
    """Pairs with equal keys whose ranges have a point in common, ends included.

    Keys with at most FEW_RANGES rows on one side, the usual ones, are joined as
    they are. For the others: of two ranges that overlap, either the right one
    starts within the left one, or the left one starts within the right one and
    after its start: two joins of ranges and points (see _stab) find each pair
    once, in work that follows the rows, the logarithm of their lengths and the
    pairs found. Rows whose key the other side lacks go no farther. Ranges are numbers
    as for range_join; one with a null end or that ends before it starts overlaps
    nothing, infinite ends are open. Column names of both sides must differ.
    """
    (a, b), (c, d) = left_range, right_range
    lefts, rights = left.withColumn("__a", a).withColumn("__b", b), right.withColumn("__c", c).withColumn("__d", d)
    lefts, rights = lefts.where("__a <= __b"), rights.where("__c <= __d")
    names = [*cols(left.columns), *cols(right.columns)]
    held, asked = [f"__x{i}" for i in range(len(on))], [f"__y{i}" for i in range(len(on))]
    of_left, of_right = ([col(pair[side]) == F.col(n) for pair, n in zip(on, marks)] for side, marks in ((0, held), (1, asked)))
    many = lefts.groupBy(*[col(x).alias(n) for (x, _), n in zip(on, held)]).agg(F.count(F.lit(1)).alias("__n"))
    more = rights.groupBy(*[col(y).alias(n) for (_, y), n in zip(on, asked)]).agg(F.count(F.lit(1)).alias("__m"))
    sizes = many.join(more, [F.col(x) == F.col(y) for x, y in zip(held, asked)] or F.lit(True))
    short = (F.least("__n", "__m") <= FEW_RANGES) & (F.greatest("__n", "__m") <= MANY_RANGES)
    sizes = write_and_read(sizes.select(*held, *asked, short.alias("__short")), "range-keys")
    usual = lefts.join(sizes.where("__short").select(*held), of_left or F.lit(True))
    together = [col(x) == col(y) for x, y in on] + [F.col("__c") <= F.col("__b"), F.col("__a") <= F.col("__d")]
    found = usual.join(rights, together).select(*names)
    longer = sizes.where("NOT __short")
    if longer.isEmpty():
        return found
    lefts = lefts.join(longer.select(*held), of_left or F.lit(True), "left_semi")
    rights = rights.join(longer.select(*asked), of_right or F.lit(True), "left_semi")
    begun = _stab(lefts.withColumnsRenamed({"__a": "__from", "__b": "__to"}), rights.withColumn("__point", F.col("__c")), on, width)
    other = [(y, x) for x, y in on]
    later = _stab(rights.withColumnsRenamed({"__c": "__from", "__d": "__to"}), lefts.withColumn("__point", F.col("__a")), other, width, True)
    return found.unionByName(begun.select(*names)).unionByName(later.select(*names))
