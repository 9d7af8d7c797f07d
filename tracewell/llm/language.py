"""Language of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col
from tracewell.llm.common import load, uniform

WORD_LETTERS = 24  # longer words are labelled in parts of this length
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % WORD_LETTERS)
FEATURES = 1 << 17
SAMPLE = 400  # labelled documents of each language that the model is fitted on
WINDOW = 60  # words of each of them
SPAN = 32  # words whose transitions are multiplied together at a time
CHUNK_CHARS = 3_000_000
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, feature weights (features x languages), transition weights, and hashes of lexicon words (sorted)."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: Sequence[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, which of them count) as words x slots, and hashes of the words.

    Slots are the letter pairs and triples with marks for both ends, prefixes and suffixes of 2 to 4 letters, and the
    word itself if the lexicon has it.
    """
    count = len(words)
    width = WORD_LETTERS + 2
    letters = np.zeros((count, width), dtype=np.uint64)
    letters[:, 0] = 1
    if count:
        letters[:, 1:-1] = np.array(words, dtype=f"U{WORD_LETTERS}").view(np.uint32).reshape(count, WORD_LETTERS)
    length = (letters[:, 1:-1] > 0).sum(axis=1)
    letters[np.arange(count), length + 1] = 2
    prime = np.uint64(0x100000001B3)
    pairs = letters[:, :-1] * prime + letters[:, 1:]
    triples = pairs[:, :-1] * prime + letters[:, 2:]
    slots, counts = [], []
    for kind, grams in ((3, pairs), (5, triples)):
        slots.append(_mix(grams * np.uint64(31) + np.uint64(kind)))
        counts.append(np.arange(grams.shape[1])[None, :] < (length + 1 if kind == 3 else length)[:, None])
    whole = np.zeros(count, dtype=np.uint64)
    at = np.arange(count)
    for n in range(1, WORD_LETTERS + 1):
        whole = np.where(length >= n, whole * prime + letters[:, n], whole)
        if 2 <= n <= 4:
            slots.append(_mix(whole * np.uint64(31) + np.uint64(7 + n))[:, None])
            counts.append((length >= n)[:, None])
    for n in range(2, 5):
        tail = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            tail = tail * prime + letters[at, np.maximum(length - n + 1 + k, 0)]
        slots.append(_mix(tail * np.uint64(31) + np.uint64(17 + n))[:, None])
        counts.append((length >= n)[:, None])
    hashes = _mix(whole)
    known = np.zeros(count, dtype=bool)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes
    slots.append(_mix(hashes + np.uint64(29))[:, None])
    counts.append(known[:, None])
    numbers = (np.concatenate(slots, axis=1) % np.uint64(FEATURES)).astype(np.int64)
    return numbers, np.concatenate(counts, axis=1), hashes


def emissions(model: Model, words: Sequence[str]) -> np.ndarray:
    """exp(score of each language - best score) for each word."""
    numbers, counts, _ = word_features(words, model.lexicon)
    scores = np.zeros((len(words), len(model.languages)))
    for slot in range(numbers.shape[1]):
        rows = np.flatnonzero(counts[:, slot])
        scores[rows] += model.weights[numbers[rows, slot]]
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def marginal_sums(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences that lie one after the other: sum of each sequence's word marginals."""
    return certain_sums(emission, lengths, transitions)[0]


def certain_sums(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`marginal_sums`, and for each sequence the sum of its words' highest marginals.

    Spans of SPAN words are handled side by side: the product of a span's step matrices takes the forward and backward
    vectors across it, so long texts need no long loop. A sequence starts from equal forward values.
    """
    states = emission.shape[1]
    move = np.exp(transitions - transitions.max())
    spans = -(-lengths // SPAN)
    total = int(spans.sum())
    sums = np.zeros((len(lengths), states))
    if not total:
        return sums, np.zeros(len(lengths))
    owner = np.repeat(np.arange(len(lengths)), spans)
    number = np.arange(total) - np.repeat(np.cumsum(spans) - spans, spans)
    start = np.repeat(np.cumsum(lengths) - lengths, spans) + number * SPAN
    size = np.minimum(SPAN, lengths[owner] - number * SPAN)
    place = start[:, None] + np.arange(SPAN)[None, :]
    inside = np.arange(SPAN)[None, :] < size[:, None]
    steps = emission[np.minimum(place, len(emission) - 1)]  # spans x SPAN x states
    # Product of the span's matrices; words beyond its end leave it as it is.
    product = np.broadcast_to(np.eye(states), (total, states, states)).copy()
    for t in range(SPAN):
        live = np.flatnonzero(inside[:, t])
        if not len(live):
            break
        moved = (product[live].reshape(-1, states) @ move).reshape(-1, states, states) * steps[live, t, None, :]
        product[live] = _scaled(moved, (1, 2))
    ahead = np.ones((total, states))  # forward values before the span
    behind = np.ones((total, states))  # backward values after it
    first = np.cumsum(spans) - spans
    for k in range(1, int(spans.max())):
        rows = first[spans > k] + k
        ahead[rows] = _scaled(np.einsum("ni,nij->nj", ahead[rows - 1], product[rows - 1]), (1,))
    for k in range(1, int(spans.max())):
        rows = (first + spans - 1)[spans > k] - k
        behind[rows] = _scaled(np.einsum("nij,nj->ni", product[rows + 1], behind[rows + 1]), (1,))
    forward = np.empty((SPAN, total, states))
    now = ahead
    for t in range(SPAN):
        now = np.where(inside[:, t, None], _scaled((now @ move) * steps[:, t], (1,)), now)
        forward[t] = now
    now, gathered, highest = behind, np.zeros((total, states)), np.zeros(total)
    for t in range(SPAN - 1, -1, -1):
        both = forward[t] * now
        marginal = np.where(inside[:, t, None], both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), 0.0)
        gathered += marginal
        highest += marginal.max(axis=1)
        now = np.where(inside[:, t, None], _scaled((steps[:, t] * now) @ move.T, (1,)), now)
    for k in range(states):
        sums[:, k] = np.bincount(owner, weights=gathered[:, k], minlength=len(lengths))
    return sums, np.bincount(owner, weights=highest, minlength=len(lengths))


def fit(windows: Sequence[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """Fit on (text, language) windows. Code-switched sequences are made by splicing parts of three windows each; their
    words carry the language of the part, so transitions are learned with everything else by the gradient of the
    conditional log-likelihood (observed minus expected features, forward-backward), with Adagrad steps."""
    windows = [(words_of(text), label) for text, label in windows]
    windows = [(w, label) for w, label in windows if w]
    languages = sorted({label for _, label in windows})
    states = len(languages)
    seen = Counter(w for words, _ in windows for w in set(words))
    common = sorted(w for w, n in seen.items() if n >= 5)
    lexicon = np.unique(word_features(common, np.zeros(0, np.uint64))[2]) if common else np.zeros(0, np.uint64)
    model = Model(languages, np.zeros((FEATURES, states)), np.zeros((states, states)), lexicon)
    if states < 2:
        return model
    vocabulary = sorted({w for words, _ in windows for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    numbers, counts, _ = word_features(vocabulary, lexicon)
    random = np.random.default_rng(seed)
    squares_w, squares_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    coded = [(np.array([place[w] for w in words]), languages.index(label)) for words, label in windows]
    for _ in range(epochs):
        order = random.permutation(len(coded))
        for at in range(0, len(order), 96):
            sequences, labels = [], []
            for group in np.array_split(order[at : at + 96], max(1, len(order[at : at + 96]) // 3)):
                parts, part_labels = [], []
                for i in group:
                    words, label = coded[i]
                    cut = random.integers(1, len(words) + 1)
                    parts.append(words[:cut] if random.random() < 0.5 else words[-cut:])
                    part_labels.append(np.full(cut, label))
                sequences.append(np.concatenate(parts))
                labels.append(np.concatenate(part_labels))
            longest = max(map(len, sequences))
            words = np.array([np.pad(s, (0, longest - len(s))) for s in sequences])
            mask = np.array([np.arange(longest) < len(s) for s in sequences])
            truth = np.array([np.pad(s, (0, longest - len(s))) for s in labels])
            used, back = np.unique(words, return_inverse=True)
            score = np.where(counts[used][:, :, None], model.weights[numbers[used]], 0.0).sum(axis=1)
            emit = np.exp(score - score.max(axis=1, keepdims=True))[back.reshape(words.shape)]
            move = np.exp(model.transitions)
            forward, backward = np.ones((longest, len(words), states)), np.ones((longest, len(words), states))
            now = np.ones((len(words), states))
            for t in range(longest):
                now = np.where(mask[:, t, None], _scaled((now @ move) * emit[:, t], (1,)), now)
                forward[t] = now
            for t in range(longest - 2, -1, -1):
                step = _scaled((emit[:, t + 1] * backward[t + 1]) @ move.T, (1,))
                backward[t] = np.where(mask[:, t + 1, None], step, 1.0)
            both = forward * backward
            marginal = (both / both.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
            error = (np.eye(states)[truth] - marginal) * mask[:, :, None]
            by_word = np.stack([np.bincount(back.ravel(), error[:, :, k].ravel(), len(used)) for k in range(states)], axis=1)
            rows, slots = np.nonzero(counts[used])
            flat = numbers[used][rows, slots]
            touched, inverse = np.unique(flat, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, by_word[rows, k], len(touched)) for k in range(states)], axis=1) / len(words)
            squares_w[touched] += gradient**2
            model.weights[touched] += rate * gradient / np.sqrt(squares_w[touched])
            pair = forward[:-1].transpose(1, 0, 2)[:, :, :, None] * move * (emit[:, 1:] * backward[1:].transpose(1, 0, 2))[:, :, None, :]
            pair = pair / np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300) * mask[:, 1:, None, None]
            observed = np.zeros((states, states))
            np.add.at(observed, (truth[:, :-1][mask[:, 1:]], truth[:, 1:][mask[:, 1:]]), 1)
            gradient = (observed - pair.sum(axis=(0, 1))) / len(words)
            squares_t += gradient**2
            model.transitions += 0.1 * gradient / np.sqrt(squares_t)
    return model


def training_windows(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW, seed: int = 5) -> list[tuple[str, str]]:
    """At most `sample` labelled documents of each language, and of each a window of `window` words at a random place.

    `docs` has (doc_id, text, lang). Rows without label or text are left out. This is the bounded sample; the counts
    behind it cover all rows.
    """
    chance = uniform(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    usable = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), col("lang").alias("lang")).where("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(1.2 * sample / n + 20 / n)) for k, n in per.items()])
    parts = F.split("text", r"\s+")
    start = F.floor(uniform(F.lit(seed + 1), F.col("doc_id")) * F.greatest(F.size(parts) - window, F.lit(1))).cast("int")
    rows = usable.where(chance < share).select(
        "lang", F.substring(F.array_join(F.slice(parts, start + 1, window), " "), 1, 40 * window).alias("part"), chance.alias("chance")
    )
    found: dict[str, list[tuple[float, str]]] = {}
    for r in rows.collect():
        found.setdefault(r["lang"], []).append((r["chance"], r["part"]))
    return [(part, lang) for lang in sorted(found) for _, part in sorted(found[lang])[:sample]]


def label_rows(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score", certainty_name: str | None = None) -> DataFrame:
    """`docs` with two more columns: the language with the largest mean word marginal, and that mean (0 to 1).

    With `certainty_name` a third one: the mean of each word's highest marginal, so a text whose words are each labelled
    with certainty has nearly 1, in however many languages it is. Only the column `text` is looked at. Null text, text
    without a letter, or a model without languages: `und` and 0.
    """
    numbers = [score_name, *([certainty_name] if certainty_name else [])]
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), *[T.StructField(n, T.DoubleType()) for n in numbers]])
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def chunks(texts: pa.Array) -> Iterator[list[list[str]]]:
        held, size = [], 0
        for value in texts:
            text = value.as_py() or ""
            held.append([w for w in words_of(text)])
            size += len(text)
            if size > CHUNK_CHARS:
                yield held
                held, size = [], 0
        yield held

    def label(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, score, certainty = [], [], []
        for held in chunks(texts):
            flat = [w for words in held for w in words]
            lengths = np.array([len(w) for w in held], dtype=np.int64)
            codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
            real = np.array([any(c.isalpha() for c in w) for w in unique], dtype=bool)
            if len(unique) and not real.all():  # marks that count as word signs without being letters
                stay = real[codes]
                lengths = np.bincount(np.repeat(np.arange(len(held)), lengths)[stay], minlength=len(held))
                codes = codes[stay]
            if model.languages and len(codes):
                sums, highest = certain_sums(emissions(model, list(unique))[codes], lengths, model.transitions)
            else:
                sums, lengths = np.zeros((len(held), max(1, len(model.languages)))), np.zeros(len(held), dtype=np.int64)
                highest = np.zeros(len(held))
            best.append(np.where(lengths > 0, sums.argmax(axis=1), len(model.languages)))
            score.append(np.where(lengths > 0, np.minimum(sums.max(axis=1) / np.maximum(lengths, 1), 1.0), 0.0))
            certainty.append(np.where(lengths > 0, np.minimum(highest / np.maximum(lengths, 1), 1.0), 0.0))
        return np.concatenate(best).astype(np.int64), np.concatenate(score), np.concatenate(certainty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, *means = label(batch.column(batch.schema.names.index("text")))
            found = [pa.array(names[best], pa.string()), *[pa.array(m) for m in means[: len(numbers)]]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, lang_name, *numbers])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Null doc_id: not held out. Repeated rows are labelled alike. An empty table gives no rows."""
    docs = load(spark, folder, "documents")
    model = fit(training_windows(docs.where(~held_out())))
    labelled = label_rows(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
