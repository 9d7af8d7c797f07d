"""Process trees: ancestors, descendants and siblings of seed processes.

Processes have a pid, a parent pid and a start time; pids are reused, so a
parent is the last process with that pid at or before the child's time. Seeds
are many at once, told apart by `seed_id`; each step is one join for all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols
from tracewell.operators.ordered import carry_last, plan_slices, running_totals
from tracewell.operators.ranges import asof_join
from tracewell.operators.rows import first_per_key
from tracewell.session import cut_lineage, write_and_read


@dataclass(frozen=True)
class ProcessColumns:
    pid: str = "process.pid"
    parent: str = "process.parent.pid"
    time: str = "@timestamp"
    tie: str = "_id"


def _plain(df: DataFrame, names: ProcessColumns) -> DataFrame:
    return df.select(
        col(names.pid).alias("pid"), col(names.parent).alias("parent_pid"), col(names.time).alias("at"),
        col(names.tie).alias("row_id"),
    )


def _edge_seed(seeds: DataFrame, names: ProcessColumns, oldest: bool) -> DataFrame:
    """One seed row per seed_id: rows are listed newest first, so the last is the oldest."""
    plain = seeds.select(
        "seed_id", col(names.pid).alias("pid"), col(names.parent).alias("parent_pid"), col(names.time).alias("at"),
        col(names.tie).alias("row_id"),
    )
    pick = F.min_by if oldest else F.max_by
    row = pick(F.struct("pid", "parent_pid", "at", "row_id"), F.struct("at", "row_id")).alias("r")
    return plain.groupBy("seed_id").agg(row).select("seed_id", "r.*")


def _seed_rows(seeds: DataFrame, names: ProcessColumns) -> DataFrame:
    return seeds.select("seed_id", col(names.tie).alias("row_id"), F.lit(0).alias("hierarchy_position"))


def ancestors(
    processes: DataFrame, seeds: DataFrame, depth: int, names: ProcessColumns = ProcessColumns(),
    not_before=None, rows_per_task: int | None = None,
) -> DataFrame:
    """(seed_id, row_id, hierarchy_position): seeds at 0, parents at -1, -2, ...

    A step asks once for every distinct (parent pid, child time) and finds the
    last process with that pid at or before it by an as-of pass over the
    processes asked for: no pid gives all its pairs. Questions come from table
    rows, so one check of the pid and parent pid groups covers every step.
    """
    table = _plain(processes, names)
    if not_before is not None:
        table = table.where(F.col("at") >= F.lit(not_before))
    edge = _edge_seed(seeds, names, oldest=True)
    asked_or_held = _plain(processes, names).select(F.explode(F.array("pid", "parent_pid")).alias("pid"), "at")
    slices = plan_slices(asked_or_held, ["pid"], "at", rows_per_task)
    found = _seed_rows(seeds, names)
    for step in range(1, depth + 1):
        ask = edge.select(F.col("parent_pid").alias("pid"), "at").where("pid IS NOT NULL").distinct()
        candidates = table.join(ask.select("pid").distinct(), "pid", "left_semi")
        marks = candidates.select("pid", F.col("at").alias("parent_at"), "parent_pid", "row_id")
        wanted = ["parent_pid", "parent_at", "row_id"]
        matched = asof_join(ask, marks, ["pid"], "at", "parent_at", wanted, "row_id", slices=slices).where("row_id IS NOT NULL")
        answer = matched.select(
            F.col("pid").alias("asked_pid"), F.col("at").alias("asked_at"), "pid", "parent_pid",
            F.col("parent_at").alias("at"), "row_id",
        )
        question = edge.select("seed_id", F.col("parent_pid").alias("asked_pid"), F.col("at").alias("asked_at"))
        edge = cut_lineage(question.join(answer, ["asked_pid", "asked_at"]).drop("asked_pid", "asked_at"))
        found = found.unionByName(edge.select("seed_id", "row_id", F.lit(-step).alias("hierarchy_position")))
    return found


def descendants(
    processes: DataFrame, seeds: DataFrame, depth: int, names: ProcessColumns = ProcessColumns(), not_after=None
) -> DataFrame:
    """(seed_id, row_id, hierarchy_position): seeds at 0, children at 1, 2, ...

    Children start at or after their parent. Every child row is listed; a
    (pid, time) that was expanded before is not expanded again.
    """
    table = _plain(processes, names)
    if not_after is not None:
        table = table.where(F.col("at") <= F.lit(not_after))
    children = table.select(F.col("parent_pid").alias("of"), "pid", "at", "row_id")
    found = _seed_rows(seeds, names)
    frontier = _edge_seed(seeds, names, oldest=False).select("seed_id", "pid", "at")
    visited = frontier
    for step in range(1, depth + 1):
        parents = frontier.select("seed_id", F.col("pid").alias("of"), F.col("at").alias("since"))
        level = cut_lineage(
            children.join(parents, "of").where("at >= since").select("seed_id", "pid", "at", "row_id")
        )
        found = found.unionByName(level.select("seed_id", "row_id", F.lit(step).alias("hierarchy_position")))
        if step == depth:
            break
        frontier = level.select("seed_id", "pid", "at").distinct().join(visited, ["seed_id", "pid", "at"], "left_anti")
        visited = cut_lineage(visited.unionByName(frontier))
    return found


def siblings(
    processes: DataFrame, seeds: DataFrame, names: ProcessColumns = ProcessColumns(), not_before=None, not_after=None
) -> DataFrame:
    """(family, row_id, is_seed): seeds, then every row with a seed's parent pid.

    Siblings are listed once per parent pid, not once per seed, so seeds that
    share a parent share the list; a seed is in it again as its own sibling.
    """
    table = _plain(processes, names)
    if not_before is not None:
        table = table.where(F.col("at") >= F.lit(not_before))
    if not_after is not None:
        table = table.where(F.col("at") <= F.lit(not_after))
    families = _edge_seed(seeds, names, oldest=True).select("parent_pid").distinct()
    own = seeds.select(col(names.parent).alias("family"), col(names.tie).alias("row_id"), F.lit(True).alias("is_seed"))
    listed = table.join(families, "parent_pid", "left_semi").select(
        F.col("parent_pid").alias("family"), "row_id", F.lit(False).alias("is_seed")
    )
    return own.unionByName(listed)


def with_rows(found: DataFrame, processes: DataFrame, names: ProcessColumns = ProcessColumns()) -> DataFrame:
    """Put the process columns back next to the positions."""
    return found.join(processes, found["row_id"] == processes[f"`{names.tie}`"]).drop("row_id").select(
        *[c for c in found.columns if c != "row_id"], *cols(processes.columns)
    )


def forest(processes: DataFrame, names: ProcessColumns = ProcessColumns(), rows_per_task: int | None = None) -> DataFrame:
    """(row_id, parent_id, at): every process once, with the row of its parent, null for roots.

    The parent is the last process with the parent pid that started before: earlier, or at the same time with a smaller
    row id, so there are no circles. Rows without a time or a parent pid are roots, and no one's parent without a time or
    a pid. Of rows with one id the earliest counts; rows without an id are left out.
    """
    table = first_per_key(_plain(processes, names).where("row_id IS NOT NULL"), ["row_id"], ["at", "pid", "parent_pid"])
    marks = table.where("pid IS NOT NULL AND at IS NOT NULL").select("pid", "at", "row_id", F.lit(1).alias("side"), F.col("row_id").alias("mark"))
    asks = table.select(F.col("parent_pid").alias("pid"), "at", "row_id", F.lit(0).alias("side"), F.lit(None).cast(table.schema["row_id"].dataType).alias("mark"))
    held = carry_last(asks.unionByName(marks), ["pid"], ["at", "row_id", "side"], {"last": F.col("mark")}, rows_per_task)
    parent = F.when(F.col("pid").isNotNull() & F.col("at").isNotNull(), F.col("last"))
    return write_and_read(held.where("side = 0").select("row_id", parent.alias("parent_id"), "at"), "forest")


def _to_root(tree: DataFrame, weights: dict[str, str]) -> DataFrame:
    """(row_id, root_id, and the sums of the weight columns on the way up, the root's left out).

    Path doubling: each round every open row takes over what the row it points at has, so paths double in length, and
    the rounds are the logarithm of the depth.
    """
    root = F.col("parent_id").isNull()
    sums = [F.when(root, F.lit(0)).otherwise(F.col(w)).cast("long").alias(n) for n, w in weights.items()]
    state = write_and_read(tree.select("row_id", F.coalesce("parent_id", "row_id").alias("up"), root.alias("done"), *sums), "paths")
    while not state.where("NOT done").isEmpty():
        ahead = state.select(F.col("row_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("there"), *[F.col(n).alias(f"more_{n}") for n in weights])
        moved = state.where("NOT done").join(ahead, "up").select(
            "row_id", F.col("next").alias("up"), F.col("there").alias("done"), *[(F.col(n) + F.col(f"more_{n}")).alias(n) for n in weights]
        )
        state = write_and_read(state.where("done").unionByName(moved), "paths")
    return state.select("row_id", F.col("up").alias("root_id"), *weights)


def roots(processes: DataFrame, names: ProcessColumns = ProcessColumns(), rows_per_task: int | None = None) -> DataFrame:
    """(row_id, root_id, depth) of every process, at any depth (see forest); a root is its own with depth 0."""
    return _to_root(forest(processes, names, rows_per_task).withColumn("one", F.lit(1)), {"depth": "one"})


def subtree_labels(
    processes: DataFrame, value: str | None = None, names: ProcessColumns = ProcessColumns(), rows_per_task: int | None = None
) -> DataFrame:
    """(row_id, root_id, depth, enter, leave, size, total) of every process (see forest).

    `size` counts a process and all below it, `total` sums `value` over them (nulls left out; null without any value).
    `enter` is its place from 0 in a walk through its tree, parents first, siblings by time and id; `leave` that of the
    last one below it. So whatever has the same root and enters from `enter` to `leave` is below it or is it: questions
    about subtrees are range predicates, without a walk.

    Sizes grow by doubling: what lies less than 2^k below a row, and what lies so below the rows 2^k below it, added up
    by partial aggregates, so a parent of any number of children is no task of its own. Places are sums of the sizes of
    earlier siblings, running in slices, along the path to the root. Rounds are the logarithm of the depth.
    """
    tree = forest(processes, names, rows_per_task)
    if value is None:
        held = tree.withColumn("total", F.lit(None).cast("double"))
    else:
        values = processes.select(col(names.tie).alias("row_id"), col(names.time).alias("at"), col(value).cast("double").alias("total"))
        held = tree.join(first_per_key(values, ["row_id"], ["at", "total"]).drop("at"), "row_id", "left")
    state = write_and_read(held.select("row_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("size"), "total"), "subtrees")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("row_id")).agg(F.sum("size").alias("more"), F.sum("total").alias("sum"))
        farther = state.where("up IS NOT NULL").select(F.col("row_id").alias("up"), F.col("up").alias("next"))
        state = write_and_read(
            state.join(below, "row_id", "left").join(farther, "up", "left").select(
                "row_id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
                F.when(F.col("total").isNull(), F.col("sum")).otherwise(F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"),
            ),
            "subtrees",
        )
    sized = tree.join(state.select("row_id", "size"), "row_id")
    children = running_totals(sized.where("parent_id IS NOT NULL"), ["parent_id"], ["at", "row_id"], {"upto": F.col("size")}, rows_per_task=rows_per_task)
    step = children.select("row_id", (F.col("upto") - F.col("size") + 1).alias("step"))
    walked = _to_root(tree.join(step, "row_id", "left").withColumn("one", F.lit(1)), {"depth": "one", "enter": "step"})
    return walked.join(state.drop("up"), "row_id").select("row_id", "root_id", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "size", "total")
