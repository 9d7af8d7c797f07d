"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col
from tracewell.llm.common import WORD, load, saved, uniform

FAN_IN = 64  # units whose masses are paired in one row of the tree
BLOCK = 10_000  # equal rows written out by one row
EDGE = 1e-9
FEW = 64  # units of a size that a rest must hold before units of that size are turned by chance
VARIETY = 32  # units kept of each doubling of size, by size modulo this number
TRIES = 64  # ways in which a rest is handed to single units


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of sources: `sizes` (source, source_size) with one row a source.

    Sources in code point order, null last, weigh the given numbers in turn and share the sum of all sizes. A target
    above `most` times its source's size stops there and the excess goes to the others by weight, until none is above:
    with sources ordered by cap / weight, the first ones stop, as long as their cap is below their share of what is left.
    A source of size 0 gets 0. The windows hold one row a source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = ranked.withColumn("share", left / F.sum("weight").over(after))
    passes = F.col("cap") > F.col("share") * F.col("weight")
    level = F.min(F.when(passes, F.struct((F.col("cap") / F.col("weight")).alias("at"), (-F.col("share")).alias("below")))).over(whole)
    return shares.select("source", "source_size", F.least("cap", F.coalesce(-level["below"] * F.col("weight"), F.col("cap"))).alias("target"))


def _pair(acc: Column, new: Column, seed: int) -> Column:
    """Let the open unit meet the next one: move mass one way, settle the one that reaches 0 or 1."""
    old = acc["open"]
    rise_old, rise_new = (1 - old["p"]) * old["size"], (1 - new["p"]) * new["size"]
    fall_old, fall_new = old["p"] * old["size"], new["p"] * new["size"]
    up, down = F.least(rise_old, fall_new), F.least(fall_old, rise_new)  # what can move to the old one, and from it
    to_old = uniform(F.lit(seed), old["unit"], new["unit"]) * (up + down) < down
    old_settles = F.when(to_old, rise_old <= fall_new).otherwise(fall_old <= rise_new)
    old_p = old["p"] + F.when(to_old, up).otherwise(-down) / old["size"]
    new_p = new["p"] - F.when(to_old, up).otherwise(-down) / new["size"]
    rest = F.struct(
        F.when(old_settles, new["size"]).otherwise(old["size"]).alias("size"),
        F.when(old_settles, new_p).otherwise(old_p).alias("p"),
        F.when(old_settles, new["unit"]).otherwise(old["unit"]).alias("unit"),
    )
    settled = F.struct(
        F.when(old_settles, old["unit"]).otherwise(new["unit"]).alias("unit"), F.when(old_settles, to_old).otherwise(~to_old).alias("up")
    )
    also = (rest["p"] < EDGE) | (rest["p"] > 1 - EDGE)
    other = F.struct(rest["unit"].alias("unit"), (rest["p"] > 0.5).alias("up"))
    paired = F.struct(
        F.when(~also, rest).alias("open"), F.concat(acc["done"], F.when(also, F.array(settled, other)).otherwise(F.array(settled))).alias("done")
    )
    return F.when(old.isNull(), F.struct(new.alias("open"), acc["done"].alias("done"))).otherwise(paired)


def pivotal_rounding(units: DataFrame, seed: int = 7) -> DataFrame:
    """Round fractional copies: `units` (stratum, unit, size > 0, p in (0, 1)) -> (stratum, unit, up boolean).

    `unit` is any struct that tells units of a stratum apart. Two open units meet, mass moves from one to the other in a
    random direction so that the sum of size * p stays and each p keeps its mean, and the one that reaches 0 or 1 is
    settled. Leaves of the tree hold about 64 units by hash; each passes at most one open unit on, and 64 nodes make the
    next one, until one unit is left in the stratum, which is rounded at random. A stratum thus misses its sum of
    size * p by less than one unit's size, and no node holds more than its fan-in, however large the stratum. The heavier of
    two units mostly stays open, so the last one may be the heaviest of all: `near_targets` hands on what it leaves.
    Chance follows from the units and `seed`. Strata may be null. A table is written for each level, a sixty-fourth of the last.
    """
    counts = units.groupBy("stratum").agg(F.ceil(F.count("*") / FAN_IN).alias("leaves")).withColumnRenamed("stratum", "of")
    width = counts.agg(F.max("leaves")).first()[0] or 0
    nodes = units.join(counts, F.col("stratum").eqNullSafe(F.col("of")), "inner").select(
        "stratum", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.col("leaves")).alias("node"), F.struct("size", "p", "unit").alias("open")
    )
    kind = nodes.schema["open"].dataType
    settled = T.ArrayType(T.StructType([T.StructField("unit", kind["unit"].dataType), T.StructField("up", T.BooleanType())]))
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(settled).alias("done"))
    parts: list[DataFrame] = [units.select("stratum", "unit", F.lit(False).alias("up")).limit(0)]
    while width:
        gathered = nodes.groupBy("stratum", "node").agg(F.sort_array(F.collect_list("open"), asc=False).alias("opens"))
        paired = gathered.select("stratum", "node", F.aggregate("opens", start, lambda acc, new: _pair(acc, new, seed)).alias("after"))
        level = saved(paired.select("stratum", "node", "after.open", "after.done"), "mixing")
        parts.append(level.select("stratum", F.explode("done").alias("d")).select("stratum", "d.unit", "d.up"))
        rest = level.where("open is not null")
        if width == 1:
            up = uniform(F.lit(seed), F.lit("last"), F.col("open.unit")) < F.col("open.p")
            parts.append(rest.select("stratum", F.col("open.unit").alias("unit"), up.alias("up")))
        nodes = rest.select("stratum", F.floor(F.col("node") / FAN_IN).alias("node"), "open")
        width = 0 if width == 1 else -(-width // FAN_IN)
    return reduce(DataFrame.unionByName, parts)


def rests(plan: DataFrame) -> DataFrame:
    """(of, rest): words a source still misses (below 0: has too many). Sizes add up as longs, so reruns agree."""
    taken = plan.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("total") * F.col("size")).alias("taken"))
    return taken.select(F.col("source").alias("of"), (F.col("target") - F.col("taken")).alias("rest"))


def near_targets(plan: DataFrame, seed: int) -> DataFrame:
    """Hand each source's signed rest to settled units: `plan` has source, doc_id, size, target, whole, total and open.

    Units with `open` may hold `whole` or `whole` + 1 copies, and are turned from one to the other. Where the units up to a
    rest's size cannot make it up, the lightest heavier one is turned first if the others can make up for that. While a rest holds `FEW`
    units of some size or more, units up to that size are turned by chance, as many as make up the rest on average; what
    is left is about an eighth. Then single units take it, the largest that brings the sum nearer first: a source
    offers up to `VARIETY` units of each doubling of size in each direction, different in size where it has such, and of
    `TRIES` ways, each but the first with another unit turned beforehand and some left out, the nearest counts. Turning does not keep the mean
    of these units, which are few next to the others. No step holds more of a source than that offer.
    """
    up, size, rest = F.col("total") > F.col("whole"), F.col("size"), F.col("rest")
    turned = F.col("whole") + (~up).cast("long")
    same = F.col("source").eqNullSafe(F.col("of"))
    unit = same & F.col("doc_id").eqNullSafe(F.col("of_id")) & (size == F.col("of_size"))

    def turn_units(steps: DataFrame) -> DataFrame:
        """Turn the units (of, of_id, of_size)."""
        marked = plan.join(saved(steps.withColumn("turn", F.lit(True)), "mixing"), unit, "left")
        return marked.withColumn("total", F.when(F.col("turn"), turned).otherwise(F.col("total"))).drop("of", "of_id", "of_size", "turn")

    right, within = up != (rest > 0), size <= F.abs(rest)
    rated = plan.where("open").join(rests(plan), same)
    sides = rated.groupBy("of").agg(
        F.max(F.abs(rest)).alias("rest"),
        F.coalesce(F.sum(F.when(right & within, size)), F.lit(0)).alias("reach"),
        F.coalesce(F.sum(F.when(~right, size)), F.lit(0)).alias("back"),
        F.min(F.when(right & ~within, F.struct("size", "doc_id"))).alias("heavy"),
    )
    sides = sides.where((F.col("reach") < rest) & (F.col("heavy.size") - rest <= F.col("back")))
    plan = saved(turn_units(sides.select("of", F.col("heavy.doc_id").alias("of_id"), F.col("heavy.size").alias("of_size"))), "mixing")
    for turn in range(64):  # a rest shrinks eightfold each time
        gaps = rests(plan)
        rated = plan.join(gaps, same, "left").withColumn("fits", F.col("open") & (up != (rest > 0)) & (size * FEW <= F.abs(rest)))
        rated = saved(rated.drop("of"), "mixing")
        room = rated.where("fits").groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("room"))
        if room.isEmpty():
            break
        chance = uniform(F.lit(seed), F.lit(turn), F.col("doc_id"), size, F.col("source")) * F.col("room") < F.abs(rest)
        moved = rated.join(room, same, "left").withColumn("total", F.when(F.col("fits") & chance, turned).otherwise(F.col("total")))
        plan = saved(moved.drop("of", "room", "rest", "fits"), "mixing")
    chance = F.xxhash64(F.lit(seed), "doc_id", "size")
    offer = plan.where("open").groupBy("source", F.floor(F.log2("size")).alias("class"), F.pmod(size, F.lit(VARIETY)).alias("kind"), up.alias("up"))
    offer = offer.agg(F.min_by(F.struct("size", "doc_id", up.alias("up")), F.struct(chance, "doc_id")).alias("unit"))
    offer = offer.groupBy("source").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units")).join(rests(plan), same).drop("of")
    tries = offer.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    beforehand = F.element_at("units", (F.pmod(F.xxhash64(F.lit(seed), "way"), F.size("units")) + 1).cast("int"))
    tries = tries.withColumn("first", F.when(F.col("way") > 0, beforehand))

    def after(rest: Column, unit: Column) -> Column:
        return rest + F.when(unit["up"], unit["size"]).otherwise(-unit["size"])

    def take(acc: Column, unit: Column) -> Column:
        nearer = F.abs(after(acc["rest"], unit)) < F.abs(acc["rest"])
        heard = (F.col("way") == 0) | (uniform(F.lit(seed), F.col("way"), unit) < 0.75) & ~unit.eqNullSafe(F.col("first"))
        return F.when(nearer & heard, F.struct(after(acc["rest"], unit).alias("rest"), F.concat(acc["turned"], F.array(unit)).alias("turned"))).otherwise(acc)

    kind = T.ArrayType(offer.schema["units"].dataType.elementType)
    start = F.struct(
        F.when(F.col("way") > 0, after(rest, F.col("first"))).otherwise(rest).cast("double").alias("rest"),
        F.when(F.col("way") > 0, F.array("first")).otherwise(F.array().cast(kind)).cast(kind).alias("turned"),
    )
    ends = tries.select("source", "way", F.aggregate("units", start, take).alias("end"))
    best = ends.groupBy("source").agg(F.min_by("end.turned", F.struct(F.abs("end.rest"), F.size("end.turned"), "way")).alias("turned"))
    steps = best.select(F.col("source").alias("of"), F.explode("turned").alias("step"))
    return turn_units(steps.select("of", F.col("step.doc_id").alias("of_id"), F.col("step.size").alias("of_size")))


def planned_units(docs: DataFrame, weights: Sequence[int], most: float, seed: int) -> DataFrame:
    """One row per distinct (doc_id, source, size): rows, source_size, target and the copies of all its rows, total."""
    rows = docs.select(col("doc_id").alias("doc_id"), col("source").alias("source"), word_count(col("text")).alias("size"))
    units = saved(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mixing")
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most)
    targets = targets.withColumnRenamed("source", "of")
    rated = units.join(targets, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    mean = F.col("rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(mean + EDGE)).withColumn("p", mean - F.col("whole"))
    rated = saved(rated, "mixing")
    rounds = (F.col("size") > 0) & (F.col("p") > EDGE)
    unit = F.struct("doc_id", "size", "rows", "source_size", "target", "whole").alias("unit")
    up = pivotal_rounding(rated.where(rounds).select(F.col("source").alias("stratum"), unit, "size", "p"), seed)
    rounded = up.select(F.col("stratum").alias("source"), "unit.*", (F.col("unit.whole") + F.col("up").cast("long")).alias("total"), F.lit(True).alias("open"))
    sure = rated.where(~rounds).withColumn("total", F.when(F.col("size") == 0, F.col("rows")).otherwise(F.col("whole")))
    plan = rounded.unionByName(sure.drop("p").withColumn("open", F.lit(False)))
    return near_targets(saved(plan, "mixing"), seed).drop("whole", "open")


def share_of(nth: Column) -> Column:
    """Copies of the n-th (from 0) of equal rows: their total dealt evenly."""
    return F.floor(F.col("total") / F.col("rows")) + (nth < F.col("total") % F.col("rows")).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    `size` counts words (null text: 0), `taken` = copies * size, and copies are the two whole numbers around
    target / source_size at most, so never above `most`. Equal (doc_id, source, size) rows are one unit for the rounding;
    its copies are dealt to them evenly, so they may differ by one. Null ids and sources are values like others. Rows
    of size 0 take nothing and keep one copy. An empty table gives no rows. Other columns are not looked at.
    """
    plan = planned_units(docs, weights, most, seed)
    # Equal rows are written out in blocks, so that no row makes a long array.
    last = F.floor((F.col("rows") - 1) / BLOCK)
    blocks = plan.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("first", F.col("block") * BLOCK)
    each = blocks.withColumn("nth", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, F.col("rows")) - 1)))
    out = each.withColumn("copies", share_of(F.col("nth")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of `docs` as many times as it is taken, all columns kept."""
    def key(of: Sequence[Column]) -> Column:
        return F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(of)])))

    plan = planned_units(docs, weights, most, seed)
    plan = plan.select(key([F.col(c) for c in ("doc_id", "source", "size")]).alias("__key"), "total", "rows")
    plan = plan.select("__key", F.struct("total", "rows").alias("__plan"))
    keyed = docs.withColumn("__key", key([col("doc_id"), col("source"), word_count(col("text"))]))
    joined = keyed.join(plan, "__key")
    # Which of several rows with one key gets a copy more follows from its text, so reruns agree.
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.md5(F.coalesce(col("text"), F.lit("")).cast("binary")))) - 1
    total, rows = F.col("__plan.total"), F.col("__plan.rows")
    copies = F.floor(total / rows) + (nth < total % rows).cast("long")
    counted = joined.withColumn("__copies", copies)
    return counted.select(*[col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(load(spark, folder, "documents")).drop("source", "copies")
