"""Hard negatives by exact integer scores: Strassen products of anchor and candidate tiles, and heaps that merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import load, saved

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score that a negative may have
SCALE = 256  # components become floor(SCALE * x)
LEAF = 16  # a product with a side of at most so many is not split further
TILE_ANCHORS, TILE_ROWS = 512, 2_048  # one product
ANCHOR_BYTES, ROW_BYTES = 32_000_000, 32_000_000  # of integers that one task holds of either side
NONE = -np.iinfo(np.int64).max  # no score: all are above -2**62, and this can be negated


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices by seven products of quarters, odd sides padded with zeros.

    Additions are exact modulo 2**64, so the result is right wherever it fits 64 bits, whatever happens in between.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    x, y, z = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), dtype=np.int64)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The k best (score, id) of each row, higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int) -> None:
        self.k = k
        self.scores = np.full((rows, k), NONE, dtype=np.int64)
        self.ids = np.zeros((rows, k), dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Offer scores[i, j] of ids[j] to heap rows[i] where fits[i, j]; what is below a heap's last score is passed over."""
        hits = fits & (scores >= self.scores[rows, -1][:, None])
        for i in np.flatnonzero(hits.any(axis=1)):
            new = np.flatnonzero(hits[i])
            both = np.append(self.scores[rows[i]], scores[i, new])
            names = np.append(self.ids[rows[i]], ids[new])
            best = np.lexsort((names, -both))[: self.k]
            self.scores[rows[i]], self.ids[rows[i]] = both[best], names[best]

    def filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of all places that are taken."""
        row, place = np.nonzero(self.scores != NONE)
        return row, self.ids[row, place], self.scores[row, place]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    """(places of anchors, places of rows) of the products of a cell."""
    for i in range(0, len(anchors), TILE_ANCHORS):
        for j in range(0, len(rows), TILE_ROWS):
            yield anchors[i : i + TILE_ANCHORS], rows[j : j + TILE_ROWS]


def _width(*tables: pa.Table) -> int:
    return max([1, *(max(t.column("v").combine_chunks().value_lengths().to_pylist(), default=1) for t in tables)])


def _equal(order: np.ndarray, values: np.ndarray, value: int) -> np.ndarray:
    """The places of a value, given the places in order of their values."""
    return order[np.searchsorted(values[order], value, "left") : np.searchsorted(values[order], value, "right")]


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a cell with each anchor's label, without rows of the anchor's own id."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        heaps = Heaps(len(anchors), k)
        if len(anchors) and len(rows):
            width = _width(anchors, rows)
            a, b = matrix(anchors.column("v"), width), matrix(rows.column("v"), width)
            own, ids = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            label, other = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
            by_label, by_other = np.argsort(label, kind="stable"), np.argsort(other, kind="stable")
            for value in np.intersect1d(label, other):
                for x, y in _tiles(_equal(by_label, label, value), _equal(by_other, other, value)):
                    heaps.add(x, strassen(a[x], b[y].T), ids[y], ids[y] != own[x][:, None])
        row, found, score = heaps.filled()
        return pa.table({"anchor": anchors.column("uid").take(pa.array(row)), "vec_id": found, "score": score})

    return run


def _negatives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a cell with another label in each window (`least`, `most`) of each anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if len(anchors) and len(rows):
            width = _width(anchors, rows)
            a, b = matrix(anchors.column("v"), width), matrix(rows.column("v"), width)
            ids, label, other = rows.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), rows.column("label").to_numpy()
            windows = anchors.column("windows").to_pylist()
            most = max(map(len, windows))
            bounds = np.array([[(w["least"], w["most"]) for w in ws] + [(0, -1)] * (most - len(ws)) for ws in windows], dtype=np.int64)
            heaps = [Heaps(len(anchors), k) for _ in range(most)]
            for x, y in _tiles(np.arange(len(anchors)), np.arange(len(rows))):
                scores = strassen(a[x], b[y].T)
                scores[label[x][:, None] == other[y]] = NONE
                for w, heap in enumerate(heaps):
                    heap.add(x, scores, ids[y], (scores >= bounds[x, w, :1]) & (scores <= bounds[x, w, 1:]) & (scores != NONE))
            for w, heap in enumerate(heaps):
                row, found, score = heap.filled()
                parts.append((row, bounds[row, w, 0], bounds[row, w, 1], found, score))
        row, least, high, found, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        return pa.table({"anchor": anchors.column("uid").take(pa.array(row)), "least": least, "most": high, "vec_id": found, "score": score})

    return run


def scaled_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, label, v array of long): rows that take part, equal ones once; uid tells rows with one id apart."""
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    found = rows.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), v.alias("x"))
    finite = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.aggregate("x", F.lit(0.0), lambda total, x: total + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")) < float(1 << 62)
    fine = found.where("vec_id is not null and label is not null and x is not null").where(finite).where(fits)
    whole = fine.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v")).distinct()
    return whole.select(F.xxhash64("vec_id", "label", "v").alias("uid"), "vec_id", "label", "v")


def _percent(share: int, score: Column, up: bool) -> Column:
    """share * score / 100, rounded up or down, without a product that overflows."""
    rest = F.pmod(score, F.lit(100))
    part = F.ceil(rest * share / F.lit(100.0)) if up else F.floor(rest * share / F.lit(100.0))
    return (F.call_function("div", score - rest, F.lit(100)) * share + part).cast("long")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
) -> DataFrame:
    """Hard negatives of the rows for which `anchors` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor, the higher the better, ties
    by the smaller id. An anchor's positives are its first `positives` other rows of the same label; the negatives of a
    pair are the first `negatives` rows of another label whose score is from `low` to `high` percent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors whose squared
    integer length reaches 2**62: no score beyond 64 bits can arise (Cauchy-Schwarz). Shorter vectors are padded with
    zeros, an empty one scores 0. Equal rows (id, label and integers) are one row; rows that share only the id are rows
    of their own, also as anchors, but never partners of their id as positives. Empty tables give no rows.

    Anchors and rows are dealt by hash to the cells of a grid, a block of each side to a cell, both bounded in bytes:
    the stated anchors meet all rows block by block. A cell's tiles are multiplied by Strassen's recursion; each cell
    keeps the best of each anchor (per label for positives, per window for negatives), and those heaps merge by rank.
    """
    spark = rows.sparkSession
    chosen = anchors.alias("__anchor")
    every = rows.select(col(id_col), col(vector_col), col(label_col), F.coalesce(chosen, F.lit(False)).alias("__anchor"))
    ready = saved(scaled_rows(every, id_col, vector_col, label_col, scale), "vectors")
    asked = saved(scaled_rows(every.where("__anchor"), id_col, vector_col, label_col, scale), "anchors")
    row_bytes, anchor_bytes = (8 * (df.agg(F.sum(F.size("v") + 4)).first()[0] or 0) for df in (ready, asked))
    row_groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-row_bytes // ROW_BYTES))
    anchor_groups = max(1, -(-anchor_bytes // ANCHOR_BYTES))

    def spread(df: DataFrame, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64("uid", F.lit(own)), F.lit(own_groups)).cast("int")).withColumn(other, every)

    def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    cells = ["across", "down"]
    candidates = spread(ready, "down", row_groups, "across", anchor_groups).groupBy(*cells)
    first = spread(asked, "across", anchor_groups, "down", row_groups).groupBy(*cells)
    near = first.cogroup(candidates).applyInArrow(_positives(positives), "anchor long, vec_id long, score long")
    near = saved(best(near, ["anchor"], positives).select("anchor", "vec_id", "score"), "positives")
    pairs = near.withColumn("least", _percent(low, F.col("score"), True)).withColumn("most", _percent(high, F.col("score"), False))
    windows = pairs.where("least <= most").groupBy("anchor").agg(F.collect_set(F.struct("least", "most")).alias("windows"))
    second = spread(asked.join(windows, asked["uid"] == windows["anchor"]).drop("anchor"), "across", anchor_groups, "down", row_groups)
    far = second.groupBy(*cells).cogroup(candidates).applyInArrow(_negatives(negatives), "anchor long, least long, most long, vec_id long, score long")
    far = best(far, ["anchor", "least", "most"], negatives).select("anchor", "least", "most", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(far, ["anchor", "least", "most"])
    ids = asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return named.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
