"""Benchmark passages in documents: winnowed word-gram fingerprints meet in a join, and hits are extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import load, saved, text_key
from tracewell.llm.ranked import LETTERS
from tracewell.llm.repeats import Hashes

SPAN = 10  # words in a row that count as a shared passage
GRAM = 5  # words of a fingerprint; the lowest of SPAN - GRAM + 1 in a row is kept, so every shared span keeps the same one
CHUNK = 4_000_000  # bytes of a text whose words are hashed at a time
FILTER_BITS = 24  # a bitmap of 2 ** FILTER_BITS bits (2 MB) tells tasks which fingerprints the benchmark may have
PAGE = 1 << 15  # bits of a bitmap row
SALTS = 16  # shares of the documents of one text in the last join


def words_of(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """Words (runs of ASCII digits and letters and of all beyond ASCII, A-Z lower-cased) and their 64-bit hashes."""
    flat = (text or b"").translate(LETTERS)
    hashes, at = [np.zeros(0, np.uint64)], 0
    while at < len(flat):
        end = flat.rfind(b" ", at, at + CHUNK) + 1 if len(flat) - at > CHUNK else len(flat)
        if not end:  # one word fills the chunk
            end = flat.find(b" ", at + CHUNK) + 1 or len(flat)
        part = flat[at:end]
        edge = np.diff((np.frombuffer(part, np.uint8) != 32).view(np.int8), prepend=0, append=0)
        hashes.append(Hashes(part).of(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        at = end
    return flat.split(), np.concatenate(hashes)


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length` words in a row; other lengths have other hashes."""
    count = max(0, len(words) - length + 1)
    out = np.full(count, length, dtype=np.uint64)
    for k in range(length):
        out = (out ^ words[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(words: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `span` words in a row the place of its lowest gram (the leftmost of equal ones); and all gram hashes."""
    grams = gram_hashes(words, gram)
    width = span - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), grams
    lowest = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return lowest + np.arange(len(lowest)), grams


def _item_windows(span: int, gram: int):
    """(item_id, length, print, window): every window of an item, or the whole of a shorter one, with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, prints, windows = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                words, hashes = words_of(text.as_py())
                length = min(span, len(words))
                if length < span:
                    found = gram_hashes(hashes, length) if length else np.zeros(0, np.uint64)
                else:
                    places, grams = winnowed(hashes, span, gram)
                    found = grams[places]
                prints += found.view(np.int64).tolist()
                windows += [b" ".join(words[i : i + length]) for i in range(len(found))]
                lengths += [length] * len(found)
                rows += [row] * len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(prints, pa.int64()), pa.array(windows, pa.binary())],
                names=["item_id", "length", "print", "window"],
            )

    return run


# Place of the gram, and the words from `at` on that windows with it can cover.
PRINTS = "array<struct<length int, print long, place int, `at` int, words binary>>"
PRINT_TYPE = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("place", pa.int32()), ("at", pa.int32()), ("words", pa.binary())]))


def _document_prints(span: int, gram: int, shorter: list[int], bitmap: np.ndarray):
    """A row per document with the fingerprints that the bitmap knows, and the words around each that a window can cover."""

    def known(hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - FILTER_BITS)
        return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def prints(words: list[bytes], hashes: np.ndarray) -> list[dict]:
        places, grams = winnowed(hashes, span, gram)
        places = np.unique(places)
        found = []
        for place in places[known(grams[places])].tolist():
            first = max(0, place - (span - gram))
            found.append((span, grams[place], place, first, words[first : place + span]))
        for length in shorter:
            short = gram_hashes(hashes, length)
            found += [(length, short[i], i, i, words[i : i + length]) for i in np.flatnonzero(known(short)).tolist()]
        return [{"length": n, "print": int(p.astype(np.int64)), "place": i, "at": j, "words": b" ".join(w)} for n, p, i, j, w in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(2):
                words, hashes = words_of(text.as_py())
                counts.append(len(words))
                found.append(prints(words, hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, PRINT_TYPE)], names=["doc_id", "text_key", "n_words", "prints"])

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bitmap of all fingerprints, 2 MB at any number of them, put together in Spark from pages."""
    slot = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    pages = windows.groupBy((slot / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg(slot % PAGE).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in pages.collect():  # at most 2 ** FILTER_BITS / PAGE rows
        out[row["page"] * (PAGE // 8) : (row["page"] + 1) * (PAGE // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def shared_passages(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Where `docs` (doc_id, text) hold passages of `items` (item_id, text).

    Returns (doc_id, n_words, spans, item_set) for every row of `docs`, and (item_set, items). `spans` are the maximal runs
    of words (`from`, `to`, half-open, from 0) inside occurrences of a window: `span` words in a row of an item, or all
    words of a shorter one. `item_set` stands for the ids (as text, sorted, each once) of the items with a window there.

    Words: see words_of. Null and empty texts have no words: no spans, and items that ask nothing. Rows of `docs` with one
    id are documents of their own; texts that repeat are worked on once after their fingerprints. Items with one id are
    one item with the windows of all; null ids take no part. Empty tables: no rows, or no spans (null item_set).

    Winnowing: of every `span - gram + 1` grams in a row the lowest hash is kept, on both sides, so every shared span has
    a kept fingerprint in common. Shorter items have one fingerprint, and documents are asked for all grams of their length.
    A bitmap of a fixed size drops most others in the tasks that read the texts; the rest are joined. Hits are extended to
    all windows around them, and these compared as words, so no result rests on a hash. Texts are read once.
    """
    asked = items.select(col("item_id").cast("string").alias("item_id"), col("text").cast("binary").alias("text")).where("item_id is not null")
    windows = saved(asked.mapInArrow(_item_windows(span, gram), "item_id string, length int, print long, window binary").distinct(), "windows")
    shorter = [r["length"] for r in windows.where(F.col("length") < span).select("length").distinct().collect()]  # at most span - 1
    rows = docs.select(col("doc_id").alias("doc_id"), text_key(col("text")).alias("text_key"), col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(_document_prints(span, gram, sorted(shorter), _bitmap(windows)), f"doc_id {kind}, text_key binary, n_words long, prints {PRINTS}")
    read = saved(read, "prints")

    prints = read.select("text_key", F.explode("prints").alias("p")).select("text_key", "p.*")
    test = windows.select("length", "print").distinct()
    hits = prints.join(test, ["length", "print"], "left_semi").dropDuplicates(["text_key", "length", "place"])
    words = F.split(F.col("words").cast("string"), " ")
    starts = F.transform(F.sequence(F.lit(0), F.size("list") - F.col("length")), lambda i: F.struct((F.col("at") + i).alias("from"), F.array_join(F.slice("list", i + 1, F.col("length")), " ").cast("binary").alias("window")))
    around = hits.withColumn("list", words).where(F.size("list") >= F.col("length")).select("text_key", "length", F.explode(starts).alias("s"))
    around = around.select("text_key", "length", "s.from", "s.window")
    whole = around.join(windows.select("window").distinct(), "window", "left_semi").dropDuplicates(["text_key", "from", "length"])
    whole = saved(whole.select("text_key", "from", (F.col("from") + F.col("length")).alias("to"), F.md5("window").alias("window")), "occurrences")

    before = Window.partitionBy("text_key").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    run = F.when(F.col("from") <= F.max("to").over(before), 0).otherwise(1)
    upto = Window.partitionBy("text_key").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)
    runs = whole.withColumn("fresh", run).withColumn("run", F.sum("fresh").over(upto)).groupBy("text_key", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = runs.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    kinds = whole.groupBy("text_key").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    kinds = saved(kinds.withColumn("item_set", F.md5(F.array_join("windows", ","))), "window-sets")
    once = kinds.groupBy("item_set").agg(F.first("windows").alias("windows")).select("item_set", F.explode("windows").alias("window"))
    of_items = windows.select(F.md5("window").alias("window"), "item_id").distinct()
    sets = once.join(of_items, "window").groupBy("item_set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    salted = spans.join(kinds.select("text_key", "item_set"), "text_key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.when(F.size("prints") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).cast("int") + SALTS)
    found = read.select("doc_id", "text_key", "n_words", share.alias("salt")).join(salted, ["text_key", "salt"], "left")
    return found.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"), "item_set"), sets


def op13(spark: SparkSession, folder: str) -> DataFrame:
    found, sets = shared_passages(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    digest = sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    digest = digest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["to"] - s["from"])
    # Clean documents have no set; a salt that no set has spreads them over the tasks of the join.
    salt = F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")
    found = found.withColumn("n_hit", hit).withColumn("salt", F.when(F.col("item_set").isNull(), F.pmod(F.hash("doc_id"), F.lit(1 << 16)) + SALTS).otherwise(salt))
    found = found.withColumn("item_set", F.coalesce("item_set", F.lit("")))
    return found.join(digest, ["item_set", "salt"], "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS w FROM (
    SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0))),
dw AS (
  SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS w FROM (
    SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS (SELECT r, n, s, w FROM dw WHERE w IN (SELECT w FROM iw)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (w)),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM found GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
