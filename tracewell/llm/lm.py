"""Stupid-backoff scores of documents from n-gram counts of all other documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import load

ORDER = 2
BACKOFF = 0.4
BATCH_WORDS = 2_000_000  # words whose n-grams are counted together before anything is shuffled
SLICE_BYTES = 12_000_000  # bytes of text behind one slice of the count tables
NO_KEY = np.uint64(0)  # the key that counts all words

STATE, ASK, ANSWER = 0, 1, 2
ROWS = "batch long, slot long, kind int, keys binary, counts binary, ids binary, mark long"


def pack(values: np.ndarray) -> bytes:
    """Integers with their bytes sorted by place, compressed."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    count, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=count * width, codec="zstd", asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, count).T).view(kind).reshape(count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to `order`: 64-bit keys of the n-grams that end at each word, and which words have one."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(tokens)) - starts
    last = hashes[tokens]
    keys = [(_mix(last), np.ones(len(tokens), dtype=bool))]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), keys[-1][0][:-1]])[: len(tokens)]
        keys.append((_mix(before * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(n)), place >= n - 1))
    return keys


class Words:
    """Words of a batch of documents, numbered as they come."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids: list = []
        self.count = 0

    def add(self, doc_id, text: bytes) -> None:
        words = text.split()  # of bytes: at ASCII white space
        if words:
            codes, unique = pd.factorize(np.array(words, dtype=object))
            number = self.number
            known = np.array([number.setdefault(w, len(number)) for w in unique], dtype=np.uint32)
            self.tokens.append(known[codes])
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.count += len(words)


def _emit(words: Words, batch: int, order: int, slices: int, id_type: pa.DataType) -> pa.RecordBatch:
    hashes = pd.util.hash_array(np.array(list(words.number), dtype=object), categorize=False) if words.number else np.zeros(0, np.uint64)
    tokens = np.concatenate(words.tokens) if words.tokens else np.zeros(0, np.uint32)
    lengths = np.array(words.lengths, dtype=np.int64)
    grams = [k[there] for k, there in gram_keys(hashes, tokens, lengths, order)]
    keys, counts = np.unique(np.concatenate([*grams, np.full(len(tokens), NO_KEY)]), return_counts=True)
    slot = ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    edges = np.searchsorted(slot, np.arange(slices + 1))
    mark = zlib.crc32(keys.tobytes())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", id_type), ("n", pa.int64())])) as out:
        out.write_batch(pa.record_batch([pa.array(words.ids, id_type), pa.array(lengths)], names=["id", "n"]))
    rows = [(batch, -1 - batch, STATE, pack(hashes), pack(tokens), sink.getvalue().to_pybytes(), mark)]
    for s in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[s], edges[s + 1]
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        rows.append((batch, s, ASK, pack(steps), pack(counts[a:b].astype(np.uint32)), b"", mark))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _count(order: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, id_type = TaskContext.get().partitionId() << 32, Words(), None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words.add(doc_id.as_py(), text.as_py() or b"")
                if words.count >= BATCH_WORDS:
                    yield _emit(words, number, order, slices, id_type)
                    number, words = number + 1, Words()
        if words.lengths:
            yield _emit(words, number, order, slices, id_type)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Add up a slice of the count table, and tell every batch the totals of the n-grams it asked for."""
    if table.column("kind")[0].as_py() == STATE:
        return table
    asked = [np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(c, "<u4") for c in table.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=counts).astype(np.uint64)[place]
    parts = np.split(totals, np.cumsum([len(a) for a in asked])[:-1])
    empty = pa.array([b""] * len(table), pa.binary())
    return pa.table(
        [table.column("batch"), table.column("slot"), pa.array([ANSWER] * len(table), pa.int32()), empty, pa.array([pack(p) for p in parts], pa.binary()), empty, table.column("mark")],
        names=table.column_names,
    )


def _score(order: int, backoff: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["kind", "slot", "counts", "mark"]).to_pylist(), key=lambda r: (r["kind"], r["slot"]))
        state = next(i for i, k in enumerate(table.column("kind").to_pylist()) if k == STATE)
        hashes = unpack(table.column("keys")[state].as_py(), "<u8")
        tokens = unpack(table.column("counts")[state].as_py(), "<u4")
        docs = pa.ipc.open_stream(table.column("ids")[state].as_py()).read_all()
        lengths = docs.column("n").to_numpy()
        grams = gram_keys(hashes, tokens, lengths, order)
        keys = np.unique(np.concatenate([*[k[there] for k, there in grams], np.full(len(tokens), NO_KEY)]))
        totals = np.concatenate([np.zeros(0, np.uint64), *[unpack(r["counts"], "<u8") for r in rows[1:]]]).astype(np.int64)
        if len(totals) != len(keys) or any(r["mark"] != zlib.crc32(keys.tobytes()) for r in rows):
            raise ValueError("a batch was read again in another order between two stages; write the documents to a table first")
        owner = np.repeat(np.arange(len(lengths)), lengths)
        # Counts in the other documents: those of all, less the document's own.
        other = []
        for k, there in grams:
            place = np.searchsorted(keys, k[there])
            _, back, own = np.unique(owner[there] * len(keys) + place, return_inverse=True, return_counts=True)
            full = np.zeros(len(tokens), dtype=np.int64)
            full[there] = totals[place] - own[back]
            other.append(full)
        words = (totals[np.searchsorted(keys, NO_KEY)] if len(tokens) else 0) - lengths[owner]
        # From the longest n-gram that is found; one factor for each step down, none for what the text's start lacks.
        logs = np.log(np.where(other[0] > 0, other[0] / np.maximum(words, 1), 1.0 / (words + 1)))
        seen = np.zeros(len(tokens), dtype=bool)
        for n in range(2, order + 1):
            there, found = grams[n - 1][1], other[n - 1] > 0
            context = np.concatenate([[1], other[n - 2][:-1]])[: len(tokens)]
            logs = np.where(there & found, np.log(np.where(found, other[n - 1], 1) / np.maximum(context, 1)), np.where(there, logs + np.log(backoff), logs))
            seen = there & found
        score = np.bincount(owner, logs, len(lengths))
        return pa.table(
            [docs.column("id"), docs.column("n"), pa.array(np.bincount(owner, seen, len(lengths)).astype(np.int64)), pa.array(score.astype(np.float64))],
            names=["doc_id", "n_words", "n_found", "score"],
        )

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_found, score, mean_score.

    `score` is the sum of ln S over the words of a document, S from the counts in all other rows: the share of the
    longest n-gram up to `order` that occurs there among its context's occurrences, times `backoff` for every order
    stepped down; a word that no other row has gets 1 / (words + 1). `n_found` counts words whose n-gram of full order
    was found. Words are runs of anything but ASCII white space. Null and empty texts: 0 words, score 0, mean null.
    Rows with equal ids or texts are documents of their own.

    Tasks explode batches of documents into n-grams and count each n-gram of a batch once; counts are dealt by hash to
    slices of the count table and added up there, and the totals are joined back to the batch's n-grams. So a word pair
    that every document has is one row a batch, and nothing grows with the frequency of a key. Keys are 64-bit hashes.
    """
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_count(order, slices), ROWS)
    answered = counted.groupBy("slot").applyInArrow(_answer, ROWS)
    scored = answered.groupBy("batch").applyInArrow(_score(order, backoff), f"doc_id {kind}, n_words long, n_found long, score double")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def op1(spark: SparkSession, folder: str) -> DataFrame:
    scores = backoff_scores(load(spark, folder, "documents"))
    return scores.select("doc_id", "n_words", "n_found", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words),
one AS (SELECT w, count(*) AS n FROM words GROUP BY 1),
one_own AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY 1, 2),
two AS (SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY 1, 2),
two_own AS (SELECT doc_id, v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY 1, 2, 3),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
found AS (
  SELECT p.doc_id, p.v, o.n - oo.n AS c1, c.n - co.n AS cv, t.n - tw.n AS c2, (SELECT count(*) FROM words) - s.n AS others
  FROM pairs p JOIN one o ON o.w = p.w JOIN one_own oo ON oo.doc_id = p.doc_id AND oo.w = p.w JOIN sizes s ON s.doc_id = p.doc_id
  LEFT JOIN one c ON c.w = p.v LEFT JOIN one_own co ON co.doc_id = p.doc_id AND co.w = p.v
  LEFT JOIN two t ON t.v = p.v AND t.w = p.w LEFT JOIN two_own tw ON tw.doc_id = p.doc_id AND tw.v = p.v AND tw.w = p.w),
logs AS (
  SELECT doc_id, coalesce(c2, 0) > 0 AS seen,
    CASE WHEN c2 > 0 THEN ln(c2 / cv)
      ELSE ln(CASE WHEN c1 > 0 THEN c1 / greatest(others, 1) ELSE 1 / (others + 1) END) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM found)
SELECT d.doc_id, coalesce(g.n, 0) AS n_words, coalesce(g.f, 0) AS n_found, round(coalesce(g.s, 0), 4) AS score, round(g.s / g.n, 6) AS mean_score
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (seen) AS f, sum(s) AS s FROM logs GROUP BY 1) g ON g.doc_id = d.doc_id
"""
