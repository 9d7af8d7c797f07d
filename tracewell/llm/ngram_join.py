"""Similarity join of documents on word n-grams: MinHash LSH forest, then exact Jaccard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import distinct_texts, load, saved, shuffle_slices, text_key
from tracewell.llm.graph import components
from tracewell.llm.lm import Words, gram_keys

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999  # of pairs at the threshold
TREES = 16
DEPTH = 6  # values of a tree's prefixes
LIKELY = 0.6  # share of equal signature values that makes a pair worth an exact look; five deviations below the threshold
BLOCK = 1_000  # texts of a group that are compared with as many others in one task


def signature_constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(17)
    return random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, count, dtype=np.uint64)


def shingles(texts: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct word n-grams of each text, one text after the other, and how many each has.

    A text of fewer than n words has one shingle, all its words; a text without words has none.
    """
    words = Words()
    for number, text in enumerate(texts):
        words.add(number, text)
    if not words.tokens:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = pd.util.hash_array(np.array(list(words.number), dtype=object), categorize=False)
    tokens, lengths = np.concatenate(words.tokens), np.array(words.lengths, dtype=np.int64)
    grams = gram_keys(hashes, tokens, lengths, n)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    there = grams[n - 1][1]
    keys, owners = [grams[n - 1][0][there]], [owner[there]]
    ends = np.cumsum(lengths) - 1
    for few in range(1, n):
        short = np.flatnonzero(lengths == few)
        keys.append(grams[few - 1][0][ends[short]])
        owners.append(short)
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[fresh], np.bincount(own[fresh], minlength=len(lengths))


def signatures(texts: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their MinHash values as 32-bit numbers: rows x TREES * DEPTH)."""
    keys, counts = shingles(texts, n)
    rows = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[rows]
    out = np.empty((len(rows), TREES * DEPTH), dtype=np.uint32)
    if len(rows):
        for k, (a, b) in enumerate(zip(*signature_constants(TREES * DEPTH))):
            out[:, k] = np.minimum.reduceat(keys * a + b, starts) >> np.uint64(32)
    return rows, out


def _forest_rows(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, values = signatures(part.column(1).to_pylist())
                keys = part.column(0).take(pa.array(rows))
                sketch = pa.array([r.tobytes() for r in values.astype(np.uint8)], pa.binary())
                for tree in range(TREES):
                    path = values[:, tree * DEPTH : (tree + 1) * DEPTH]
                    first = path[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + path[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(tree)
                    slot = ((first ^ (first >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(slots)
                    paths = pa.array([bytes([tree]) + r.tobytes() for r in path.astype(">u4")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), paths, sketch, keys], names=["slot", "path", "sketch", "text_key"])

    return run


def shortest_prefix(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Prefix length at which the forest finds `recall` of the pairs at the threshold: shortened value by value."""
    length = DEPTH
    while length > 1 and 1 - (1 - threshold**length) ** TREES < recall:
        length -= 1
    return length


class Roots:
    """Union-find over row numbers."""

    def __init__(self, count: int) -> None:
        self.of = list(range(count))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
        return a != b


def _likely(sketches: np.ndarray, one: int, rows: np.ndarray) -> np.ndarray:
    return (sketches[rows] == sketches[one]).mean(axis=1) >= LIKELY


def _link(sketches: np.ndarray, rows: np.ndarray, roots: Roots) -> list[tuple[int, int]]:
    """Join what likely pairs among `rows` connect; the edges that were needed, fewer than rows.

    The first row left takes all that are like it, then the next; two groups that are still apart are compared pair by
    pair until one likely pair is found.
    """
    edges: list[tuple[int, int]] = []
    left, groups = rows, []
    while len(left):
        near = _likely(sketches, left[0], left)
        near[0] = True
        edges += [(int(left[0]), int(r)) for r in left[near][1:] if roots.join(int(left[0]), int(r))]
        groups.append(left[near])
        left = left[~near]
    for k, group in enumerate(groups):
        for other in groups[k + 1 :]:
            if roots.find(int(group[0])) == roots.find(int(other[0])):
                continue
            few, many = sorted((group, other), key=len)
            for r in few.tolist():
                hits = many[_likely(sketches, r, many)]
                if len(hits):
                    roots.join(r, int(hits[0]))
                    edges.append((r, int(hits[0])))
                    break
    return edges


def _candidates(shortest: int) -> Callable[[pa.Table], pa.Table]:
    """Walk the sorted prefixes of a slot from the longest to the shortest and link likely pairs below each."""

    def run(table: pa.Table) -> pa.Table:
        size = 1 + 4 * DEPTH
        path = np.frombuffer(b"".join(table.column("path").to_pylist()), np.uint8).reshape(-1, size)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(path), -1)
        order = np.lexsort(path.T[::-1])
        path, sketch = path[order], sketch[order]
        roots, edges = Roots(len(path)), []
        for length in range(DEPTH, shortest - 1, -1):
            same = np.zeros(len(path), dtype=bool)
            same[1:] = (path[1:, : 1 + 4 * length] == path[:-1, : 1 + 4 * length]).all(axis=1)
            starts = np.flatnonzero(~same)
            sizes = np.diff(np.append(starts, len(path)))
            for start, count in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                if len({roots.find(r) for r in range(start, start + count)}) > 1:  # else a longer prefix has joined them
                    edges += _link(sketch, np.arange(start, start + count), roots)
        keys = table.column("text_key").take(pa.array(order))
        a, b = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b))})

    return run


def _common(keys: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two of the sets share, by products of 0/1 matrices."""
    everything = np.concatenate(keys)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    _, column, times = np.unique(everything, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    out = np.zeros((len(keys), len(keys)), dtype=np.float32)
    width = max(256, 16_000_000 // max(1, len(keys)))
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        here = (column >= at) & (column < at + width)
        part = np.zeros((len(keys), min(width, int(column.max()) + 1 - at)), dtype=np.float32)
        part[owner[here], column[here] - at] = 1
        out += part @ part.T
    return out


def _verify(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Exact Jaccard of all pairs of each (group, block, block): links of each text by weight, and a forest of the linked."""

    def run(table: pa.Table) -> pa.Table:
        text_keys, weights = table.column("text_key").to_pylist(), table.column("n").to_numpy()
        block = table.column("block").to_numpy()
        flat, counts = shingles(table.column("text").to_pylist())
        sets = np.split(flat, np.cumsum(counts)[:-1])
        work: dict[tuple, list[int]] = {}
        for row, key in enumerate(zip(table.column("root").to_pylist(), table.column("i").to_pylist(), table.column("j").to_pylist())):
            work.setdefault(key, []).append(row)
        out: list[tuple[bytes, int, bytes]] = []
        for (_, i, j), rows in work.items():
            at, size = np.array(rows), counts[rows].astype(np.float32)
            common = _common([sets[r] for r in rows])
            linked = common >= np.float32(threshold) * (size[:, None] + size[None, :] - common) - np.float32(1e-3)
            if i != j:
                linked &= block[at][:, None] != block[at][None, :]
            np.fill_diagonal(linked, False)
            links = linked @ weights[at]
            root = np.arange(len(rows))
            for a in range(len(rows)):
                near = np.flatnonzero(linked[a, :a])
                if len(near):
                    roots = np.unique(np.append(root[near], root[a]))
                    root[np.isin(root, roots)] = roots[0]
            out += [(text_keys[r], int(n), text_keys[rows[g]]) for r, n, g in zip(rows, links, root)]
        key, links, root = zip(*out) if out else ((), (), ())
        return pa.table({"text_key": pa.array(key, pa.binary()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.binary())})

    return run


def linked_texts(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Of distinct texts (text_key, text binary, n): (text_key, links, root) of those with a similar text.

    `links` counts other texts with a Jaccard similarity of word 5-grams of at least `threshold`, each as often as it
    occurs; `root` is the smallest key of the connected texts. Prefixes of the forest are shortened until pairs at the
    threshold are found with `recall`; below each prefix pairs with LIKELY equal signature values are linked, and within
    the groups so connected every pair is compared exactly, in blocks, so that a large group is spread over tasks.
    """
    slots = shuffle_slices(texts)
    forest = texts.select("text_key", "text").mapInArrow(_forest_rows(4 * slots), "slot long, path binary, sketch binary, text_key binary")
    edges = forest.groupBy("slot").applyInArrow(_candidates(shortest_prefix(threshold, recall)), "a binary, b binary")
    hooked = components(edges)
    member = hooked.select(F.col("node").alias("text_key"), "root").unionByName(hooked.select(F.col("root").alias("text_key"), "root").distinct())
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = saved(member.join(sizes, "root"), "members")
    placed = texts.join(member, "text_key").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "text_key", "text", "n")
    slot = F.pmod(F.xxhash64("root", "i", "j"), F.lit(2 * slots))
    found = saved(paired.withColumn("slot", slot).groupBy("slot").applyInArrow(_verify(threshold), "text_key binary, links long, root binary"), "links")
    links = found.groupBy("text_key").agg(F.sum("links").alias("links")).where("links > 0")
    tree = components(found.where(F.col("text_key") != F.col("root")).select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    return links.join(tree.select(F.col("node").alias("text_key"), "root"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, class_id, n_links, n_copies, text_key, class_key.

    `n_links` counts the other rows whose text has a Jaccard similarity of at least `threshold` on word 5-grams, copies
    among them; `class_id` is the smallest doc_id of the rows that are connected by such links, `n_copies` the rows with
    the same text. A text of fewer than five words is one shingle. Rows without a word (null, empty) link to nothing, not
    even each other, and are classes of their own. A null id is kept, and is a class id only where all ids are null.
    Rows with equal ids are documents of their own. An empty table gives no rows.
    """
    texts = distinct_texts(docs)
    linked = linked_texts(texts, threshold, recall)
    rows = docs.select(col("doc_id").alias("doc_id"), text_key(col("text")).alias("text_key"), (F.regexp_count(F.coalesce(col("text"), F.lit("")), F.lit(r"^[\x20\x09-\x0D]*+$")) > 0).alias("blank"))
    known = texts.select("text_key", "n").join(linked, "text_key", "left").select("text_key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "text_key").alias("class_key"))
    joined = saved(rows.join(known, "text_key"), "classes")
    least = joined.where("not blank").groupBy("class_key").agg(F.min("doc_id").alias("least")).withColumnRenamed("class_key", "of")
    out = joined.join(least, F.col("class_key") == F.col("of"), "left")
    return out.select(
        "doc_id",
        F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.when(F.col("blank"), F.lit(0)).otherwise(F.col("links") + F.col("n") - 1).alias("n_links"),
        F.col("n").alias("n_copies"),
        "text_key",
        "class_key",
        "blank",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class, that of the smallest doc_id (then the smallest text key); all columns kept.

    Rows without a word all stay.
    """
    found = similar_documents(docs)
    keep = found.where("not blank").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k"))
    keep = keep.select(F.col("k.text_key").alias("__keep_key"), F.col("k.doc_id").alias("__keep_id"))
    keyed = docs.withColumn("__key", text_key(col("text"))).withColumn("__blank", F.regexp_count(F.coalesce(col("text"), F.lit("")), F.lit(r"^[\x20\x09-\x0D]*+$")) > 0)
    joined = keyed.join(keep, F.col("__key") == F.col("__keep_key"), "left")
    chosen = joined.where(F.col("__blank") | (F.col("__keep_key").isNotNull() & col("doc_id").eqNullSafe(F.col("__keep_id"))))
    again = F.row_number().over(Window.partitionBy("__key", col("doc_id")).orderBy(F.lit(0)))
    return chosen.withColumn("__nth", again).where(F.col("__blank") | (F.col("__nth") == 1)).select(*[col(c) for c in docs.columns])


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(load(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP8_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, md5(coalesce(text, '')) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
texts AS (SELECT t, any_value(ws) AS ws, count(*) AS n FROM rows_ GROUP BY 1),
shingles AS (
  SELECT DISTINCT t, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT t, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT t, count(*) AS k FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.t AS x, b.t AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.t <> b.t GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.t = x JOIN sizes q ON q.t = y WHERE c / (p.k + q.k - c) >= 0.8),
reach AS (
  SELECT t AS x, t AS y FROM texts
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
ids AS (SELECT t, min(doc_id) AS d FROM rows_ GROUP BY 1),
classes AS (SELECT x, min(d) AS class_id FROM reach JOIN ids ON ids.t = reach.y GROUP BY 1),
counts AS (SELECT x, sum(n) AS k FROM links JOIN texts ON texts.t = links.y GROUP BY 1)
SELECT r.doc_id, CASE WHEN len(r.ws) = 0 THEN r.doc_id ELSE c.class_id END AS class_id,
  CAST(CASE WHEN len(r.ws) = 0 THEN 0 ELSE coalesce(k.k, 0) + t.n - 1 END AS BIGINT) AS n_links, t.n AS n_copies
FROM rows_ r JOIN texts t ON t.t = r.t JOIN classes c ON c.x = r.t LEFT JOIN counts k ON k.x = r.t
"""
