"""Ranked lexical search in integers: short posting lists summed term by term, long ones passed through document by document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col
from tracewell.llm.common import load, saved
from tracewell.llm.lm import pack, unpack

TOP = 10
SPAN = 64  # documents that the iterators pass at a time, with one maximum of each list
SHORT = 16  # lists with at most one posting for so many documents are short
PIECE_WORDS = 3_000_000  # words of a piece of the index, built where its documents are read
UNIT = 1_000_000_000  # numerator of the share of a term's weight
#: Digits, letters and all beyond ASCII make words; A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False).view(np.int64) if terms else np.zeros(0, np.int64)


def _index(id_type: pa.DataType):
    """Pieces of the index: documents in the order they come, terms by hash, and their postings by document."""
    schema = pa.schema([("id", id_type), ("n", pa.int64())])

    def piece(number: dict, words: list, times: list, ids: list) -> pa.RecordBatch:
        hashes = term_hashes(list(number))
        unique, rank = np.unique(hashes, return_inverse=True)
        lengths = np.array([t.sum() for t in times], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        key = rank[np.concatenate(words)] * len(ids) + owner if len(unique) else np.zeros(0, np.int64)
        by = np.argsort(key, kind="stable")
        # Words whose hashes are equal count as one term: their postings of a document are added up.
        key, tf = key[by], np.concatenate(times)[by]
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        key, tf = key[fresh], np.add.reduceat(tf, fresh) if len(fresh) else tf
        sizes = np.bincount(key // max(1, len(ids)), minlength=len(unique))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.array(ids, id_type), pa.array(lengths)], schema=schema))
        blobs = (sink.getvalue().to_pybytes(), pack((key % max(1, len(ids))).astype(np.uint32)), pack(tf.astype(np.uint32)))
        numbers = pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())
        lists = pa.array([unique], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*numbers, *lists, *[pa.array([x], pa.binary()) for x in blobs]], names=["docs", "words", "terms", "sizes", "ids", "spots", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, times, ids, count = {}, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                counts = Counter(terms_of(text.as_py()))
                words.append(np.fromiter((number.setdefault(w, len(number)) for w in counts), np.int64, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
                ids.append(doc_id.as_py())
                count += int(times[-1].sum())
                if count >= PIECE_WORDS:
                    yield piece(number, words, times, ids)
                    number, words, times, ids, count = {}, [], [], [], 0
        if ids:
            yield piece(number, words, times, ids)

    return run


class Piece:
    """A piece of the index in memory: posting lists by document, and each list's maximum in each span of documents it has."""

    def __init__(self, row: dict, docs: int, words: int) -> None:
        found = pa.ipc.open_stream(row["ids"]).read_all()
        self.ids, lengths = found.column("id").to_pylist(), found.column("n").to_numpy()
        self.terms = np.array(row["terms"], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.array(row["sizes"], dtype=np.int64))])
        self.spots = unpack(row["spots"], "<u4").astype(np.int64)
        tf = unpack(row["times"], "<u4").astype(np.int64)
        m = 10 + (90 * lengths * docs) // max(1, words)
        self.share = (UNIT * tf) // (1000 * tf + 8 * m[self.spots])  # of the term's weight
        self.spans = -(-len(self.ids) // SPAN)

    def lists(self, hashes: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of the query's terms that the piece has, shortest list first."""
        at = np.searchsorted(self.terms, hashes)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == hashes[there]
        bounds = [(self.starts[i], self.starts[i + 1], w) for i, w in zip(at[there], weights[there])]
        return [(self.spots[s:e], self.share[s:e] * w) for s, e, w in sorted(bounds, key=lambda b: b[1] - b[0])]

    def search(self, hashes: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The k best of `best` and this piece's documents, as (-score, id) in order.

        Term at a time: the short lists are summed into accumulators, which become one more list, in document order and
        with maxima. Document at a time: its cursor and those of the long lists go through the documents span by span;
        where the maxima of a span cannot reach the k-th score, all cursors skip it, and in the others only documents
        that can still reach it are looked up in the long lists, strongest list first.
        """
        lists = self.lists(hashes, weights)
        if not lists:
            return best
        short = [x for x in lists if len(x[0]) * SHORT <= len(self.ids)]
        iterators = lists[len(short) :]
        if short:
            spots = np.concatenate([s for s, _ in short])
            order = np.argsort(spots, kind="stable")
            spots, fresh = np.unique(spots[order], return_index=True)
            sums = np.add.reduceat(np.concatenate([v for _, v in short])[order], fresh)
            iterators = [(spots, sums), *iterators]
        bar = -best[k - 1][0] if len(best) >= k else 1
        for _, values in iterators:  # scores of single lists are the least that their documents reach
            if len(values) >= k:
                bar = max(bar, int(np.partition(values, -k)[-k]))
        maxima = np.zeros((len(iterators), self.spans), dtype=np.int64)
        for row, (spots, values) in enumerate(iterators):
            span = spots // SPAN
            fresh = np.flatnonzero(np.diff(span, prepend=-1))
            maxima[row, span[fresh]] = np.maximum.reduceat(values, fresh)
        bounds = maxima.sum(axis=0)
        cursors = [0] * len(iterators)
        place = -1
        while True:
            ahead = np.flatnonzero(bounds[place + 1 :] >= bar)
            if not len(ahead):
                return best
            place += 1 + int(ahead[0])  # the next span that can hold one of the k best
            first = place * SPAN
            scores = np.zeros(SPAN, dtype=np.int64)
            left = int(bounds[place])
            for row in np.argsort(-maxima[:, place], kind="stable"):
                most = int(maxima[row, place])
                if not most or int(scores.max()) + left < bar:
                    break
                spots, values = iterators[row]
                start = cursors[row] + int(np.searchsorted(spots[cursors[row] :], first))
                end = start + int(np.searchsorted(spots[start : start + SPAN], first + SPAN))
                cursors[row] = end
                scores[spots[start:end] - first] += values[start:end]
                left -= most
            else:
                left = 0
            if left:
                continue
            good = np.flatnonzero((scores >= bar) & (scores > 0))
            if len(good):
                best = sorted([*best, *((-int(scores[g]), self.ids[first + g]) for g in good)], key=_rank)[:k]
                bar = max(bar, -best[k - 1][0] if len(best) >= k else 1)


def _rank(found: tuple) -> tuple:
    return (found[0], found[1] is None, found[1] if found[1] is not None else 0)


def _search(k: int, docs: int, words: int, id_type: pa.DataType):
    """Rows of a partition in order: the pieces of a group, then its queries, which look into all of them in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pieces = None, []
        for batch in batches:
            found: list[tuple] = []
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["grp"] != group:
                    group, pieces = row["grp"], []
                if row["query"] is None:
                    pieces.append(Piece(row, docs, words))
                    continue
                best: list[tuple] = []
                hashes, weights = np.array(row["terms"], dtype=np.int64), np.array(row["sizes"], dtype=np.int64)
                for piece in pieces:
                    best = piece.search(hashes, weights, best, k)
                found += [(row["query"], doc, -score) for score, doc in best]
            q, d, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, id_type), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(term_hashes(terms_of(text.as_py()))) for text in batch.column(1)]
        take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["item_id", "term"])


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k highest-scoring rows of `docs` (doc_id, text) for each of `items` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII digits and letters and of anything beyond ASCII, A-Z lower-cased; a document's score sums, over
    the item's distinct terms, w * (10**9 * tf div (1000 * tf + 8 * m)), with w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 10 + 90 * n * N div L; N counts documents with a term, L all their terms. Scores are integers, only those above 0
    count; equal ones go by ascending doc_id, nulls last. Null and empty texts have no terms, find nothing and are not found.
    Items with one id are one item of all their terms; null ids ask nothing. Rows of `docs` with one id are documents of
    their own, a repeated row takes a rank of its own. Empty tables give no rows.

    Each input partition builds pieces of the index in place; they are written once, moved once to their group, and every
    group takes all items one after the other, so neither side is ever held whole. The best of all groups are merged.
    """
    spark = docs.sparkSession
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())
    schema = "docs long, words long, terms array<long>, sizes array<long>, ids binary, spots binary, times binary"
    index = saved(rows.mapInArrow(_index(id_type), schema), "index")
    totals = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("l"), F.count("*").alias("pieces")).first()
    number, words = totals["n"] or 0, totals["l"] or 0
    asked = items.select(col("item_id").alias("item_id"), col("text").cast("binary").alias("text")).where("item_id is not null")
    item_kind = asked.schema["item_id"].dataType.simpleString()
    wanted = saved(asked.mapInArrow(_asked, f"item_id {item_kind}, term long").distinct(), "terms")
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("t"), F.col("x.sizes").alias("df"))
    held = held.join(wanted.select(F.col("term").alias("w")).distinct(), F.col("t") == F.col("w"), "left_semi").groupBy("t").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * number + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = wanted.join(held, F.col("term") == F.col("t")).groupBy("item_id").agg(F.collect_list(F.struct("term", weight.cast("long").alias("w"))).alias("x"))
    queries = saved(weighed.select(F.xxhash64("item_id").alias("query"), "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("sizes")), "items")
    groups = max(1, totals["pieces"])
    blobs = ["ids", "spots", "times"]
    dealt = index.select(F.pmod(F.xxhash64("words", "docs", F.hash("spots")), F.lit(groups)).alias("grp"), F.lit(None).cast("long").alias("query"), "terms", "sizes", *blobs)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1))).alias("grp")
    dealt = dealt.unionByName(queries.select(every, "query", "terms", "sizes", *[F.lit(None).cast("binary").alias(b) for b in blobs]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // 8))
    dealt = dealt.repartition(parts, "grp").sortWithinPartitions("grp", F.col("query").asc_nulls_first())
    found = dealt.mapInArrow(_search(k, number, words, id_type), f"query long, doc_id {kind.simpleString()}, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tf AS (
  SELECT r, doc_id, w, count(*) AS tf FROM (
    SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM words) GROUP BY ALL),
docs AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM docs),
weights AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, total GROUP BY w, n_docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM items JOIN weights USING (w) JOIN tf USING (w) JOIN docs USING (r), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
