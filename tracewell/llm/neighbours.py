"""Approximate nearest neighbours over balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import load, saved, uniform

LIST_ROWS = 256  # vectors a list should hold
MOST_LISTS = 65_536  # bound of the centroids that tasks keep in memory; beyond it lists grow
SAMPLE_PER_LIST = 48  # vectors the centroids are fitted on: at most so many a list, and
MOST_SAMPLE = 200_000  # so many in all
REPLICAS = 4  # lists that a boundary vector may be in
REPLICA_RATIO = 1.2  # ... with centroids at most so many times as far as the nearest one
SEARCH_RATIO = 1.4  # lists searched: centroids at most so many times as far as the nearest one, if that is enough, and
FIRST_LISTS = 64  # so many at first; more, and then at any distance, until the recall is reached
RECALL = 0.995  # of the nearest rows of FIT_QUERIES queries, found by brute force
FIT_QUERIES = 256
WALK_SHARE = 16  # the graph is walked for less than one list of so many, else all centroids are compared
DEGREE = 16
CHUNK_ROWS = 4_096  # rows of a list that one group holds


@dataclass
class Index:
    """Unit centroids and their neighbour graph."""

    centroids: np.ndarray
    graph: np.ndarray

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * unit @ self.centroids.T, 0.0))

    def search(self, unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk through the graph: the `count` nearest centroids met, and their distances."""
        start = np.unique(np.linspace(0, len(self.centroids) - 1, min(8, len(self.centroids))).astype(int))
        near = np.sqrt(np.maximum(2 - 2 * self.centroids[start] @ unit, 0.0))
        seen = set(start.tolist())
        ahead = list(zip(near.tolist(), start.tolist()))
        heapq.heapify(ahead)
        best = [(-d, c) for d, c in ahead]
        heapq.heapify(best)
        while ahead:
            d, c = heapq.heappop(ahead)
            if len(best) >= count and d > -best[0][0]:
                break
            fresh = [x for x in self.graph[c].tolist() if x not in seen]
            seen.update(fresh)
            for e, x in zip(np.sqrt(np.maximum(2 - 2 * self.centroids[fresh] @ unit, 0.0)).tolist(), fresh):
                if len(best) < count or e < -best[0][0]:
                    heapq.heappush(ahead, (e, x))
                    heapq.heappush(best, (-e, x))
                    if len(best) > count:
                        heapq.heappop(best)
        found = sorted((-d, c) for d, c in best)
        return np.array([c for _, c in found]), np.array([d for d, _ in found])

    def near(self, unit: np.ndarray, count: int, ratio: float) -> np.ndarray:
        """Up to `count` nearest centroids, at most `ratio` times as far as the nearest one."""
        if count * WALK_SHARE < len(self.centroids):
            lists, away = self.search(unit, count)
        else:
            every = self.distances(unit[None])[0]
            lists = np.argsort(every, kind="stable")[:count]
            away = every[lists]
        return lists[away <= ratio * max(away[0], 1e-6)]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_index(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> Index:
    """Spherical k-means whose large clusters are split and small ones given up, then a graph of nearest centroids."""
    random = np.random.default_rng(seed)
    points = np.unique(unit_rows(sample), axis=0)
    lists = max(1, min(lists, len(points)))
    centroids = points[random.choice(len(points), lists, replace=False)]
    for turn in range(rounds):
        owner = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(points, -(-len(points) // 4096))])
        counts = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
        if turn < rounds - 2:
            mean = len(points) / len(centroids)
            large = np.flatnonzero(counts > 2 * mean)
            small = np.argsort(counts, kind="stable")[: len(large)]
            for big, spare in zip(large[np.argsort(-counts[large])], small):
                if counts[spare] < mean / 2:
                    centroids[spare] = points[random.choice(np.flatnonzero(owner == big))]
    near = min(DEGREE, len(centroids) - 1)
    graph = np.zeros((len(centroids), max(near, 0) + 2), dtype=np.int64)
    for at in range(0, len(centroids), 2048):
        close = centroids[at : at + 2048] @ centroids.T
        close[np.arange(len(close)), at + np.arange(len(close))] = -2
        if near > 0:
            graph[at : at + 2048, :near] = np.argpartition(-close, near - 1, axis=1)[:, :near]
    graph[:, -2:] = random.integers(0, len(centroids), (len(centroids), 2))  # far links keep the graph in one piece
    return Index(centroids, graph)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v double array): without null ids, null, empty or zero vectors, and null or non-finite components.

    Vectors of another length than the most common one (ties: the shorter) take no part either. Equal rows are one.
    """
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    found = rows.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = found.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (lengths["d"] if lengths else 0))


def assign_lists(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, v, first): the nearest list of each vector, and up to REPLICAS lists about as near.

    A further list is left out if its centroid is nearer to one already chosen than to the vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = index.distances(index.centroids) if len(index.centroids) <= 4096 else None
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                away = index.distances(unit_rows(matrix(part.column(1))))
                order = np.argsort(away, axis=1, kind="stable")[:, : 2 * REPLICAS]
                lists, rows, first = [], [], []
                for row, near in enumerate(order.tolist()):
                    chosen: list[int] = []
                    for c in near:
                        d = away[row, c]
                        if len(chosen) == REPLICAS or d > REPLICA_RATIO * away[row, near[0]]:
                            break
                        others = between[c, chosen] if between is not None else index.distances(index.centroids[c : c + 1])[0, chosen]
                        if not chosen or (others > d).all():
                            lists.append(c)
                            rows.append(row)
                            first.append(not chosen)
                            chosen.append(c)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int64()), part.column(0).take(take), part.column(1).take(take), pa.array(first, pa.bool_())],
                    names=["list", "vec_id", "v", "first"],
                )

    return vectors.mapInArrow(run, "list long, vec_id long, v array<double>, first boolean")


@dataclass
class Search:
    """How queries choose lists: up to `count` within `ratio`, and at least the first list of `least` vectors."""

    index: Index
    sizes: np.ndarray
    least: int
    count: int = FIRST_LISTS
    ratio: float = SEARCH_RATIO

    def lists(self, unit: np.ndarray) -> np.ndarray:
        chosen = self.index.near(unit, self.count, self.ratio)
        if self.sizes[chosen].sum() < self.least:
            everything = np.argsort(self.index.distances(unit[None])[0], kind="stable")
            chosen = everything[: int(np.searchsorted(np.cumsum(self.sizes[everything]), self.least)) + 1]
        return chosen


def brute_force(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    """(q, vec_id): the k nearest rows of each of few queries, which every task compares with all its rows; q is the place in `ids`."""
    units = unit_rows(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, owner = np.full((len(ids), k), -4.0), np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                own = part.column(0).to_numpy()
                scores = units @ unit_rows(matrix(part.column(1))).T
                scores[ids[:, None] == own[None, :]] = -4
                scores, names = np.hstack([best, scores]), np.hstack([owner, np.broadcast_to(own, scores.shape)])
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best, owner = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        q, place = np.nonzero(best > -3)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(owner[q, place]), pa.array(best[q, place])], names=["q", "vec_id", "score"])

    found = vectors.select("vec_id", "v").mapInArrow(run, "q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "vec_id")


def fit_search(search: Search, vectors: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> Search:
    """The search with the fewest lists that finds RECALL of the nearest rows of FIT_QUERIES queries, if need be all lists."""
    total = len(search.index.centroids)
    drawn = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).select("query_id", "v").toArrow()
    if total == 1 or not len(drawn):
        return search
    asked = matrix(drawn.column("v"))
    truth = brute_force(vectors, drawn.column("query_id").to_numpy(), asked, k)
    held: dict[tuple[int, int], set[int]] = {}  # at most FIT_QUERIES * k keys
    for r in postings.join(F.broadcast(truth), "vec_id").select("q", "vec_id", "list").distinct().collect():
        held.setdefault((r["q"], r["vec_id"]), set()).add(r["list"])
    units, count = unit_rows(asked), min(FIRST_LISTS, total)
    while True:
        for ratio in (SEARCH_RATIO, float("inf")):
            tried = Search(search.index, search.sizes, search.least, count, ratio)
            read = [set(tried.lists(unit).tolist()) for unit in units]
            if sum(bool(lists & read[q]) for (q, _), lists in held.items()) >= RECALL * len(held) or (count == total and ratio > SEARCH_RATIO):
                return tried
        count = min(total, count + count // 4)


def route_queries(queries: DataFrame, search: Search) -> DataFrame:
    """(list, query_id, v): the lists each query is looked up in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, lists, rows = batch.slice(at, 256), [], []
                for row, unit in enumerate(unit_rows(matrix(part.column(1)))):
                    chosen = search.lists(unit)
                    lists += chosen.tolist()
                    rows += [row] * len(chosen)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int64()), part.column(0).take(take), part.column(1).take(take)], names=["list", "query_id", "v"]
                )

    return queries.mapInArrow(run, "list long, query_id long, v array<double>")


def _scan(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of a group for each query in it, by cosine in doubles; equal scores by smaller id."""

    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(postings) and len(queries):
            ids = postings.column("vec_id").to_numpy()
            rows, asked = matrix(postings.column("v")), matrix(queries.column("v"))
            unit = unit_rows(rows)
            norms = np.sqrt((rows * rows).sum(axis=1))
            for at in range(0, len(asked), 512):
                rough = unit_rows(asked[at : at + 512]) @ unit.T
                for q, query, scores in zip(queries.column("query_id").to_pylist()[at : at + 512], asked[at : at + 512], rough):
                    scores[ids == q] = -3
                    bar = np.partition(scores, -k)[-k] if len(scores) > k else -2
                    close = np.flatnonzero(scores >= max(bar - 1e-9, -2))
                    exact = (rows[close] * query).sum(axis=1) / (norms[close] * np.sqrt((query * query).sum()))
                    found += [(q, int(ids[close[i]]), float(exact[i])) for i in np.lexsort((ids[close], -exact))[:k]]
        q, v, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to `k` nearest rows of each query by cosine, not counting the query's own id.

    Rows that cannot take part (see usable_vectors) are left out on both sides; without any the result is empty. All
    usable rows are in the index; the centroids are fitted on a bounded sample. How many lists are read is fitted at the
    table's own size, on a bounded set of the queries against brute force. A list of many rows, such as one of
    equal vectors, is cut into chunks of CHUNK_ROWS, and its queries look into each.
    """
    vectors = saved(usable_vectors(rows, id_col, vector_col), "vectors")
    count = vectors.count()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MOST_LISTS, count // LIST_ROWS))
    wanted = min(MOST_SAMPLE, SAMPLE_PER_LIST * lists)
    drawn = vectors.where(uniform(F.lit(1), "vec_id") < 1.1 * wanted / count + 1e-4).limit(wanted).select("v").toArrow()
    index = fit_index(matrix(drawn.column("v")) if len(drawn) else matrix(vectors.limit(wanted).select("v").toArrow().column("v")), lists)
    postings = saved(assign_lists(vectors, index), "postings")
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts")).collect()  # at most MOST_LISTS rows
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in counts:
        sizes[r["list"]] = r["firsts"]
    chunks = rows.sparkSession.createDataFrame(
        [(r["list"], -(-r["n"] // CHUNK_ROWS)) for r in counts], "of long, chunks long"
    )
    asked = usable_vectors(queries, id_col, vector_col).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"])
    search = fit_search(Search(index, sizes, 8 * (k + 1)), vectors, postings, asked, k)
    routed = route_queries(asked, search).join(F.broadcast(chunks), F.col("list") == F.col("of"))
    routed = routed.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "query_id", "v")
    dealt = postings.join(F.broadcast(chunks), F.col("list") == F.col("of")).select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).alias("chunk"), "vec_id", "v"
    )
    found = dealt.groupBy("list", "chunk").cogroup(routed.groupBy("list", "chunk")).applyInArrow(_scan(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
