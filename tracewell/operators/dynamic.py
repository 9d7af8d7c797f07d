"""Dynamic aggregation: merge rows that differ in one key, greedily, in layers.

In a layer the first row not yet merged takes, among the lines through it (rows
equal on all dynamic keys but one), the one with the most unmerged rows, the
earlier key on ties. The merged row keeps the common keys and lists the values
of the dropped one. Layers repeat while the number of rows shrinks.

A row's choice depends only on rows it can reach over shared lines, so connected
components are independent. A layer that fits one batch is solved in one task;
otherwise components are found first, at any size of the table, and those within
the limit are solved in batches inside tasks. Larger components are cut into blocks of
consecutive rows, all solved at once under what the last round assumed of the
other blocks, until nothing changes (solve_by_blocks). Merging itself is a plain Spark
aggregation in all cases.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.aggregate import ORDERED, PARTIAL, Spec, aggregate, aggregate_columns, expand_spec
from tracewell.operators.connected import connected
from tracewell.session import cut_lineage, new_path, write_and_read

ID = "__id"
COMPONENT_ROWS = 200_000


def dynamic_aggregate(
    df: DataFrame,
    groupby: Sequence[str],
    spec: Spec,
    dynamic_keys: Sequence[str],
    dynamic_spec: Spec,
    list_to_text: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
    component_rows: int = COMPONENT_ROWS,
    layers: int | None = None,
) -> DataFrame:
    """Columns: dynamic keys, the columns of `dynamic_spec`, aggregated = true. At most `layers` layers, if given."""
    triples = expand_spec(dynamic_spec)
    if unknown := sorted({fn for _, fn, _ in triples} - {*PARTIAL, *ORDERED}):
        raise ValueError(f"{unknown} cannot be taken over layers; known: {sorted([*PARTIAL, *ORDERED])}")
    base = aggregate(df, groupby, spec, list_to_text, order_by)
    # Each result has a column of its own from the start, so that a layer can read what the last one made.
    base = base.select("*", *[col(column).alias(name) for column, _, name in triples if name != column])
    dynamic_spec = {name: fn for _, fn, name in triples}
    kept = list(dynamic_spec)
    text_keys = [F.coalesce(col(k).cast("string"), F.lit("-")).alias(k) for k in dynamic_keys]
    # Ids follow the group order, nulls last, and are fixed by the checkpoint.
    in_order = base.orderBy(*[col(g).asc_nulls_last() for g in groupby])
    rows = cut_lineage(in_order.select(F.monotonically_increasing_id().alias(ID), *text_keys, *cols(dynamic_spec)))
    size = rows.count()
    while layers is None or layers > 0:
        merged = cut_lineage(merge_layer(rows, dynamic_keys, dynamic_spec, size, component_rows))
        merged_size = merged.count()
        if merged_size >= size:
            break
        rows, size = merged, merged_size
        layers = None if layers is None else layers - 1
    return rows.select(*cols(dynamic_keys), *cols(kept), F.lit(True).alias("aggregated"))


def merge_layer(rows: DataFrame, keys: Sequence[str], spec: Spec, size: int, component_rows: int) -> DataFrame:
    seeds = write_and_read(assign_seeds(rows, keys, size, component_rows), "seeds")
    joined = rows.join(seeds, ID)
    values = [
        F.when(F.col("field") == i, F.array_join(F.sort_array(F.collect_set(F.when(F.col("field") == i, col(k)))), ","))
        .otherwise(F.min(col(k)))
        .alias(k)
        for i, k in enumerate(keys)
    ]
    columns = aggregate_columns(expand_spec(spec), [ID])
    # All rows of a seed were merged over the same field, so it may be a group column.
    return joined.groupBy("seed", "field").agg(*values, *columns).drop("field").withColumnRenamed("seed", ID)


def line_edges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, field, line, size): line = number of the line got by dropping field."""
    names = [f"__k{i}" for i in range(len(keys))]
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("field"),
                *[(F.lit("") if j == i else col(k)).alias(names[j]) for j, k in enumerate(keys)],
            )
            for i in range(len(keys))
        ]
    )
    through = rows.select(ID, F.inline(lines))
    # The first row on a line, with the field, names the line.
    numbered = through.groupBy("field", *names).agg(
        (F.min(ID) * len(keys) + F.col("field")).alias("line"), F.count(F.lit(1)).alias("size")
    )
    return through.join(numbered, ["field", *names]).select(ID, "field", "line", "size")


def assign_seeds(rows: DataFrame, keys: Sequence[str], size: int, component_rows: int) -> DataFrame:
    """(id, seed, field) for every row: no task sees more than whole components of a bounded size, or a block of rows."""
    edges = line_edges(rows, keys)
    if size <= component_rows:
        return solve_in_tasks(wide_rows(edges).withColumn("batch", F.lit(0)))
    edges = write_and_read(edges, "lines")
    # Rows alone on all their lines stay as they are.
    alone = edges.groupBy(ID).agg(F.max("size").alias("most")).where("most = 1")
    result = alone.select(ID, F.col(ID).alias("seed"), F.lit(0).alias("field"))
    # A line's number holds its first row: rows are linked to it, without a join. Lines of one row link nothing, but a row
    # that shares another line needs them later.
    first = F.floor(F.col("line") / len(keys)).cast("long")
    labels = write_and_read(connected(edges.where("size > 1").select(F.col(ID).alias("a"), first.alias("b"))).toDF(ID, "label"), "labels")
    edges = edges.join(labels.select(ID), ID, "left_semi")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    is_small = F.col("rows") <= component_rows
    # At most a label per component_rows rows; the rows of one stay where they are.
    long = F.broadcast(sizes.where(~is_small).select("label"))
    summary = sizes.agg(F.sum(F.when(is_small, F.col("rows"))).alias("small"), F.sum(F.when(~is_small, F.col("rows"))).alias("large")).first()
    if summary["small"]:
        # Four batches per limit, as hashing does not fill them evenly.
        batches = -(-4 * summary["small"] // component_rows)
        small = labels.join(long, "label", "left_anti")
        batch = F.pmod(F.xxhash64("label"), F.lit(batches)).alias("batch")
        result = result.unionByName(solve_in_tasks(wide_rows(edges).join(small, ID).select(ID, "lines", batch)))
    if summary["large"]:
        large = labels.join(long, "label", "left_semi")
        blocks = -(-summary["large"] // component_rows)
        result = result.unionByName(solve_by_blocks(wide_rows(edges.join(large.select(ID), ID, "left_semi")), blocks))
    return result


def wide_rows(edges: DataFrame) -> DataFrame:
    """(id, lines): the lines through each row, in the order of the keys."""
    wide = edges.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("field", "line"))).alias("lines"))
    return wide.select(ID, F.col("lines.line").alias("lines"))


def solver():
    """The greedy pass over rows in id order. Built inside a function so that workers get it by value, without this package."""

    def solve(ids, lines, outside=None, leaving=(), taken=None):
        """(time, pick, field) by row: the row that takes it, the field of the line it chose if it acts itself (else -1), the field merged over.

        `outside`: rows of other tasks still open on a line when this pass begins. `leaving`: (time, line, n) in order:
        of these, n are gone for rows after `time`. `taken`: (time, field) of rows that other tasks take before the pass.
        """
        time, field, pick = [None] * len(ids), [0] * len(ids), [-1] * len(ids)
        on_line: dict[int, list[int]] = {}
        open_rows = dict(outside or {})
        for place, through in enumerate(lines):
            if taken and taken[place]:
                time[place], field[place] = taken[place]
                continue
            for line in through:
                on_line.setdefault(line, []).append(place)
                open_rows[line] = open_rows.get(line, 0) + 1
        gone = 0
        for place, through in enumerate(lines):
            if time[place] is not None:
                continue
            while gone < len(leaving) and leaving[gone][0] < ids[place]:
                open_rows[leaving[gone][1]] -= leaving[gone][2]
                gone += 1
            best = max(range(len(through)), key=lambda f: open_rows[through[f]])
            pick[place] = best
            for other in on_line[through[best]]:
                if time[other] is None:
                    time[other], field[other] = ids[place], best
                    for line in lines[other]:
                        open_rows[line] -= 1
        return time, pick, field

    return solve


def solve_in_tasks(source: DataFrame) -> DataFrame:
    """Rows (id, lines, batch) solved in row order; batches hold whole components."""
    solve = solver()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id", ignore_index=True)
        ids = pdf["__id"].tolist()
        seed, _, field = solve(ids, [x.tolist() for x in pdf["lines"]])
        return pd.DataFrame({"__id": ids, "seed": seed, "field": field})

    return source.groupBy("batch").applyInPandas(run, f"{ID} bigint, seed bigint, field int")


STATE = f"{ID} bigint, block int, lines array<bigint>, time bigint, time_block int, pick int, field int, moved bigint"


def solve_by_blocks(wide: DataFrame, blocks: int) -> DataFrame:
    """The greedy pass over components of any size: (id, seed, field).

    Rows are dealt to `blocks` of consecutive ids. A row's time is the id of the row that takes it (its own, if it acts).
    In a round every block is solved in id order, in one task, while the rest is taken from the round before: which
    rows of earlier blocks take a line, and when rows of other blocks leave one. The sequential result is the only
    one that such a round reproduces: all that happens before the first change is as there, so it is written out and
    goes. At least one more row is settled a round; in dense components nearly all choices stand
    at once, as they do not hang on the last few rows of a line. A chain through all rows takes a round per block.

    A task holds its block's rows, a number per line of these, and when rows of other blocks which its own
    rows take leave another line of the block: those at the edges of the block, as ids follow the keys' order.
    """
    spark, kinds = wide.sparkSession, f"{ID} bigint, seed bigint, field int"
    path = new_path(spark, "merged")
    dealt = wide.repartitionByRange(blocks, ID).withColumn("block", F.spark_partition_id())
    # At first every row is taken to act itself.
    state = write_and_read(dealt.selectExpr(ID, "block", "lines", f"{ID} AS time", "block AS time_block", "-1 AS pick", "0 AS field"), "state")
    while True:
        state = write_and_read(solve_round(state), "state")
        first = state.agg(F.min("moved")).first()[0]
        settled = state if first is None else state.where(F.col("time") < first)
        settled.select(ID, F.col("time").alias("seed"), "field").write.mode("append").parquet(path)
        if first is None:
            return spark.read.schema(kinds).parquet(path)
        state = state.where(F.col("time") >= first)


def solve_round(state: DataFrame) -> DataFrame:
    """The state after every block was solved once more; `moved` is the earliest time that a row's change touches."""
    through = state.select("block", "time", "time_block", F.explode("lines").alias("line"))
    # Rows on a line by the block in which they are taken; a block asks for those taken later. A list is at most the number of blocks.
    marks = through.select(
        "line",
        F.inline(
            F.array(
                F.struct(F.col("time_block").alias("at"), F.lit(1).alias("rows"), F.lit(False).alias("asks")),
                F.struct(F.col("block").alias("at"), F.lit(0).alias("rows"), F.lit(True).alias("asks")),
            )
        ),
    )
    marks = marks.groupBy("line", "at").agg(F.sum("rows").alias("rows"), F.max("asks").alias("asks"))
    after = Window.partitionBy("line").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    asked = marks.withColumn("later", F.coalesce(F.sum("rows").over(after), F.lit(0))).where("asks").select("line", "at", "later")
    # The first row that chose a line. One of another block comes before all rows of the block or after them.
    picks = state.where("pick >= 0").groupBy(F.get("lines", F.col("pick")).alias("line"))
    picks = picks.agg(F.min(F.struct(F.col(ID).alias("time"), F.col("block").alias("time_block"), "field")).alias("by"))
    early = F.col("by.time_block") < F.col("at")
    by = [F.coalesce(F.when(early, F.col(f"by.{c}")), F.lit(-1)).alias(f"by_{c}") for c in ("time", "time_block", "field")]
    lines = asked.join(picks, "line", "left").select("at", "line", "later", F.lit(-1).cast("long").alias("time"), *by)
    # Rows of other blocks that rows of this one take.
    leaving = through.where("time_block <> block").groupBy("line", F.col("time_block").alias("at"), "time").agg(F.count(F.lit(1)).alias("later"))
    leaving = leaving.join(asked.select("line", "at"), ["line", "at"], "left_semi")
    nobody = [F.lit(-1).alias(c) for c in ("by_time", "by_time_block", "by_field")]
    told = lines.unionByName(leaving.select("at", "line", "later", "time", *nobody))
    solve = solver()

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__id", ignore_index=True)
        ids, lines = rows["__id"].tolist(), [x.tolist() for x in rows["lines"]]
        here = int(rows["block"].iloc[0])
        events = told[told["time"] >= 0].sort_values(["time", "line"])
        leaving = list(zip(events["time"].tolist(), events["line"].tolist(), events["later"].tolist()))
        fixed = told[told["time"] < 0]
        outside = dict(zip(fixed["line"].tolist(), fixed["later"].tolist()))
        for _, line, n in leaving:
            outside[line] += n
        known = fixed[fixed["by_time"] >= 0]
        takers = dict(zip(known["line"].tolist(), known[["by_time", "by_time_block", "by_field"]].itertuples(index=False, name=None)))
        first = [min((takers[line] for line in through if line in takers), default=None) for through in lines]
        taken = [(by[0], by[2]) if by else None for by in first]
        time, pick, field = solve(ids, lines, outside, leaving, taken)
        block = [by[1] if by else here for by in first]
        before = rows[["time", "pick", "field"]].itertuples(index=False, name=None)
        moved = [None if old == new else min(old[0], new[0]) for old, new in zip(before, zip(time, pick, field))]
        return pd.DataFrame(
            {"__id": ids, "block": here, "lines": rows["lines"], "time": time, "time_block": block, "pick": pick, "field": field,
             "moved": pd.array(moved, dtype="Int64")}
        )

    return state.groupBy("block").cogroup(told.groupBy("at")).applyInPandas(run, STATE)
