"""Exact removal of long repeated byte strings with a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import distinct_texts, load, saved, shuffle_slices, text_key
from tracewell.session import new_path

LENGTH = 400  # bytes that must repeat
SEED_BYTES = 64  # bytes at the start of a suffix that is sampled
BATCHES = 4
HOT_RUNS = 20_000  # runs with one seed that are still compared in one task
BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < count:
        size = max(count, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:count], _POWERS[1][:count]


class Hashes:
    """Hashes of all substrings of a text from one pass over it."""

    def __init__(self, text: bytes) -> None:
        codes = _letters()[np.frombuffer(text, np.uint8)]
        up, self.down = _powers(len(text) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sampled_suffixes(text: bytes, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """(key, span, at, lo, hi) of a text's runs: strings of `length` bytes starting at lo..hi that share their sampled suffix.

    Each such string is served by the suffix inside it whose first `seed` bytes hash lowest (the leftmost of equal ones),
    so equal strings have their suffix at the same place in them and meet under the same key, the hash of those bytes.
    `span` is the hash of all that the run covers, and of the places of its ends: equal spans repeat each other wholly.
    """
    n = len(text) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = Hashes(text)
    seeds = hashes.windows(seed)
    width = length - seed + 1
    # Lowest of each `width` neighbours, by prefix and suffix minima of blocks; ties to the left.
    shift = np.uint64(max(24, len(seeds).bit_length()))
    order = ((seeds >> shift) << shift) | np.arange(len(seeds), dtype=np.uint64)
    blocks = np.full(-(-len(order) // width) * width + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(order)] = order
    square = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    at = (lowest & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    lo, hi = first, np.append(first[1:], n) - 1
    at = at[first]
    places = (at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
    return seeds[at], _mix(hashes.of(lo, hi + length) + _mix(places)), at, lo, hi


def _suffix_rows(length: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for row, text in enumerate(batch.column(1)):
                part = sampled_suffixes(text.as_py(), length, seed)
                found.append(part)
                rows.append(np.full(len(part[0]), row))
                if sum(map(len, rows[-1:])) and len(rows) % 512 == 0:
                    yield from flush(batch, found, rows)
                    found, rows = [], []
            yield from flush(batch, found, rows)

    def flush(batch: pa.RecordBatch, found: list, rows: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        key, span, at, lo, hi = (np.concatenate(x) for x in zip(*found))
        take = pa.array(np.concatenate(rows), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(take), batch.column(2).take(take)]
            + [pa.array(x.astype(np.int32)) for x in (at, lo, hi)],
            names=["seed", "span", "text_key", "n", "at", "lo", "hi"],
        )

    return run


class SuffixLevels:
    """Levels of sorted suffix tables (seed, span, n), bucketed and sorted by seed, whose sizes double.

    `add` takes a batch of suffix rows, makes its table, scans it side by side with every level (bucketed alike, so by a
    merge join without a shuffle), keeps the seeds that meet, and merges tables of the same size.
    """

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, table)
        self.met: list[DataFrame] = []

    def _table(self, rows: DataFrame) -> DataFrame:
        name = f"tracewell_suffixes_{uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "seed").sortBy("seed").option("compression", "zstd")
        writer.option("path", new_path(self.spark, "suffixes")).saveAsTable(name)
        return self.spark.table(name)

    def add(self, rows: DataFrame) -> None:
        counted = rows.groupBy("seed", "span").agg(F.sum("n").alias("n"))
        table, size = self._table(counted.repartition(self.buckets, "seed")), 1
        self.met.append(table.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed"))
        for _, level in self.levels:
            self.met.append(table.select("seed").distinct().join(level.select("seed"), "seed", "left_semi"))
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            table = self._table(level.unionByName(table).groupBy("seed", "span").agg(F.sum("n").alias("n")))
            size *= 2
        self.levels.append((size, table))

    def matches(self) -> DataFrame:
        """(seed, span, n, mixed) of the seeds that occur more than once; mixed: one of its spans occurs just once."""
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        seeds = self.met[0]
        for more in self.met[1:]:
            seeds = seeds.unionByName(more)
        counted = rows.join(saved(seeds.distinct(), "seeds"), "seed", "left_semi").groupBy("seed", "span").agg(F.sum("n").alias("n"))
        counted = saved(counted, "seeds")
        singles = counted.where("n = 1").select("seed").distinct().withColumn("mixed", F.lit(True))
        return counted.join(singles, "seed", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))


def _run_texts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the bytes of runs out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, flat = [], []
            for row, (text, runs) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                data = text.as_py()
                for r in runs:
                    rows.append(row)
                    flat.append((r["seed"], r["n"], r["at"], r["lo"], data[r["lo"] : r["hi"] + length]))
            for a in range(0, max(len(rows), 1), 20_000):
                seed, n, at, lo, data = zip(*flat[a : a + 20_000]) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(data, pa.binary())]
                    + [batch.column(0).take(pa.array(rows[a : a + 20_000], pa.int64()))],
                    names=["seed", "n", "at", "lo", "data", "text_key"],
                )

    return run


def _window_keys(seeds: np.ndarray, at: np.ndarray, lo: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all strings of `length` bytes of the runs (what they hold, and where their seed is), and strings per run."""
    sizes = np.array([len(t) - length + 1 for t in texts], dtype=np.int64)
    keys = np.concatenate([Hashes(t).windows(length) for t in texts]) if texts else np.zeros(0, np.uint64)
    number = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(at - lo, sizes) - number
    return _mix(keys + _mix(np.repeat(seeds.view(np.uint64), sizes) + place.astype(np.uint64) * np.uint64(BASE))), sizes


def _resolve(length: int) -> Callable[[pa.Table], pa.Table]:
    """Strings that occur twice among the runs of a group: (text_key, from, to) of the parts they cover."""

    def run(table: pa.Table) -> pa.Table:
        lo = table.column("lo").to_numpy().astype(np.int64)
        seeds, at = table.column("seed").to_numpy(), table.column("at").to_numpy().astype(np.int64)
        keys, sizes = _window_keys(seeds, at, lo, table.column("data").to_pylist(), length)
        owner = np.repeat(np.arange(len(lo)), sizes)
        _, back = np.unique(keys, return_inverse=True)
        twice = np.bincount(back, weights=table.column("n").to_numpy()[owner])[back] > 1
        number = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins = np.flatnonzero(twice & ~((number > 0) & np.concatenate([[False], twice[:-1]])))
        last = np.concatenate([number[1:] == 0, [True]])
        ends = np.flatnonzero(twice & (last | ~np.concatenate([twice[1:], [False]])))
        rows = owner[begins]
        return pa.table(
            [table.column("text_key").take(pa.array(rows, pa.int64())), pa.array((lo[rows] + number[begins]).astype(np.int32)), pa.array((lo[rows] + number[ends] + length).astype(np.int32))],
            names=["text_key", "from", "to"],
        )

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per string of a run; for seeds with more runs than one task compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                lo = part.column("lo").to_numpy().astype(np.int64)
                keys, sizes = _window_keys(part.column("seed").to_numpy(), part.column("at").to_numpy().astype(np.int64), lo, part.column("data").to_pylist(), length)
                number = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                owner = pa.array(np.repeat(np.arange(len(lo)), sizes))
                begin = np.repeat(lo, sizes) + number
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), part.column("n").take(owner), part.column("text_key").take(owner), pa.array(begin.astype(np.int32))],
                    names=["string", "n", "text_key", "from"],
                )

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, parts in zip(batch.column(1), batch.column(2)):
            data, parts = text.as_py(), parts.as_py() or []
            kept, at, removed, spans = [], 0, 0, 0
            for begin, end in sorted((p["from"], p["to"]) for p in parts):
                if begin > at or not spans:
                    spans += 1
                    kept.append(data[at:begin])
                    removed -= max(begin, at)
                    removed += end
                    at = end
                elif end > at:
                    removed += end - at
                    at = end
            kept.append(data[at:])
            rows.append((len(data), removed, spans, b"".join(kept)))
        size, removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            + [pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def removed_repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, batches: int = BATCHES, with_bytes: bool = True) -> DataFrame:
    """Of distinct texts (text_key binary, text binary, n: times it occurs): what is left without long repeats.

    Returns (text_key, n_bytes, n_removed, n_spans, kept_sha256, kept). `texts` should be a table: it is read three times.
    """
    spark = texts.sparkSession
    buckets = shuffle_slices(texts)
    schema = "seed long, span long, text_key binary, n long, at int, lo int, hi int"
    found = texts.select("text_key", "text", "n").where(F.octet_length("text") >= length).mapInArrow(_suffix_rows(length, seed), schema)
    path = new_path(spark, "suffix-rows")
    found.withColumn("batch", F.pmod(F.xxhash64("text_key"), F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    index = SuffixLevels(spark, buckets)
    for number in range(batches):
        index.add(rows.where(F.col("batch") == number))
    met = saved(rows.drop("batch").join(index.matches().withColumnsRenamed({"seed": "s", "span": "p", "n": "total"}), (F.col("seed") == F.col("s")) & (F.col("span") == F.col("p"))).drop("s", "p"), "runs")
    settled = met.where("total > 1").select("text_key", F.col("lo").alias("from"), (F.col("hi") + length).alias("to"))
    # Runs whose span is alone are compared with each other and with one of each repeated span of their seed.
    alone = met.where("total = 1").select("seed", "text_key", "total", "at", "lo", "hi")
    spans = met.where("total > 1 and mixed").groupBy("seed", "span").agg(F.min(F.struct("text_key", "total", "at", "lo", "hi")).alias("r"))
    compared = alone.unionByName(spans.select("seed", "r.*")).withColumnRenamed("total", "n")
    counts = compared.groupBy("seed").agg(F.count("*").alias("of")).where(F.col("of") > HOT_RUNS).select("seed").withColumn("hot", F.lit(True))
    by_text = compared.groupBy("text_key").agg(F.collect_list(F.struct("seed", "n", "at", "lo", "hi")).alias("runs"))
    cut = texts.select("text_key", "text").join(by_text, "text_key").mapInArrow(_run_texts(length), "seed long, n long, at int, lo int, data binary, text_key binary")
    cut = saved(cut.join(F.broadcast(counts), "seed", "left"), "run-texts")  # no more hot seeds than runs / HOT_RUNS
    parts = "text_key binary, `from` int, `to` int"
    few = cut.where("hot is null").drop("hot").groupBy(F.pmod(F.xxhash64("seed"), F.lit(4 * buckets)).alias("slot")).applyInArrow(_resolve(length), parts)
    strings = cut.where("hot").drop("hot").mapInArrow(_windows(length), "string long, n long, text_key binary, `from` int")
    twice = strings.groupBy("string").agg(F.sum("n").alias("times")).where("times > 1").withColumnRenamed("string", "s")
    many = strings.join(twice, F.col("string") == F.col("s"), "left_semi").select("text_key", "from", (F.col("from") + length).alias("to"))
    removed = settled.unionByName(few).unionByName(many).groupBy("text_key").agg(F.collect_list(F.struct("from", "to")).alias("parts"))
    out = "text_key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.select("text_key", "text").join(removed, "text_key", "left").mapInArrow(_remove, out)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in the texts, in the same one or
    another row; matches lie within texts and are judged on the input. Texts are UTF-8 bytes, null is empty. Equal texts
    repeat each other, so they go wholly from `length` bytes on; they are worked on once, with their number. Rows with
    equal ids are documents of their own. An empty table gives no rows.
    """
    texts = distinct_texts(docs)
    digest = removed_repeats(texts, length).drop("kept")
    keys = docs.select(col("doc_id").alias("doc_id"), text_key(col("text")).alias("text_key"))
    return keys.join(digest, "text_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(load(spark, folder, "documents"))
