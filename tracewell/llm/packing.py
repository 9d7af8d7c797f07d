"""Best-fit packing of tokenised documents into fixed sequences, bettered by swap-based local search."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col
from tracewell.llm.common import load, saved

SEQUENCE = 1024
GROUP_ROWS = 16_384  # documents that are packed together first
FAN_IN = 4  # groups' worth of pieces of poor sequences that are packed again together
NEIGHBOURS = 64
PATIENCE = 8
POOR = 0.95  # sequences filled less are taken apart for the next round
END_OF_TEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Ids as the library `tokenizers` gives them for this byte-level BPE file, by a faster reader of the same merges.

    The file's own pattern and vocabulary are used; the marker of its one special token is that token, as there.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    back = {c: b for b, c in byte_letters().items()}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(back[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def ids(text: str) -> list[int]:
        if any(m in text for m in marks):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    return ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of pieces: one, or full ones after a first that may be shorter."""
    head = len(ids) % size if len(ids) > size else len(ids)
    starts = [0] if len(ids) <= size else ([0] if head else []) + list(range(head, len(ids), size))
    ends = [*starts[1:], len(ids)]
    return [(a, ids[a:b]) for a, b in zip(starts, ends)]


class Bins:
    """Sequences being filled: item lengths, items of each bin, and the free room."""

    def __init__(self, lengths: np.ndarray, size: int) -> None:
        self.lengths, self.size = lengths, size
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        by_room: dict[int, list[int]] = defaultdict(list)
        rooms = 0  # bit r: some bin has r tokens of room
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[item])
            fits = rooms >> n << n
            if fits:
                room = (fits & -fits).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.items[at].append(item)
                self.fill[at] += n
            else:
                at, room = len(self.items), self.size
                self.items.append([item])
                self.fill.append(n)
            if room > n:
                by_room[room - n].append(at)
                rooms |= 1 << (room - n)

    def local_search(self) -> None:
        """Pass tokens from the emptiest bin to fuller ones, so that the sum of squared fills rises, until it is empty.

        A step moves one item, exchanges one for a shorter one, two for a shorter one, or one for two that are shorter
        together; takers are the NEIGHBOURS bins with most room. It ends when the room left over is less than a bin,
        when no bin is poor, or when PATIENCE givers in turn could not be emptied.
        """
        stuck: set[int] = set()
        while len(stuck) < PATIENCE:
            under = [b for b in range(len(self.items)) if self.items[b] and self.fill[b] < self.size]
            if sum(self.size - self.fill[b] for b in under) < self.size:
                return
            givers = [b for b in under if b not in stuck]
            if not givers:
                return
            giver = min(givers, key=lambda b: self.fill[b])
            if self.fill[giver] >= POOR * self.size:
                return
            others = [b for b in under if b != giver]
            while self.items[giver] and self._step(giver, others):
                pass
            if self.items[giver]:
                stuck.add(giver)

    def _step(self, giver: int, takers: list[int]) -> bool:
        """The step from `giver` that fills a taker most; False if there is none."""
        takers = [b for b in takers if self.items[b] and self.fill[b] < self.size and self.fill[b] >= self.fill[giver]]
        takers = sorted(takers, key=lambda b: self.fill[b])[:NEIGHBOURS]
        if not takers:
            return False
        own = self.items[giver]
        own_sets = [[i] for i in own] + [[i, j] for x, i in enumerate(own[:40]) for j in own[x + 1 : 40]]
        own_sums = np.array([self.lengths[s].sum() for s in own_sets])
        single = np.array([len(s) == 1 for s in own_sets])
        room = np.array([self.size - self.fill[b] for b in takers])
        # What a taker may give back: nothing, one item, or two items.
        back, at, pair = [[]] * len(takers), list(range(len(takers))), [False] * len(takers)
        for k, b in enumerate(takers):
            items = self.items[b]
            back += [[i] for i in items]
            at += [k] * len(items)
            pair += [False] * len(items)
            if len(items) <= 40:
                two = [[i, j] for x, i in enumerate(items) for j in items[x + 1 :]]
                back += two
                at += [k] * len(two)
                pair += [True] * len(two)
        back_sums = np.array([self.lengths[s].sum() if s else 0 for s in back])
        limit = room[np.array(at)]
        best = (0, -1, -1)
        for n, one in sorted(set(zip(own_sums.tolist(), single.tolist())), reverse=True):
            if n <= best[0]:
                break
            gain = n - back_sums
            fits = (gain > 0) & (gain <= limit) & (one | ~np.array(pair))
            if fits.any():
                gains = np.where(fits, gain, 0)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    chosen = int(np.flatnonzero((own_sums == n) & (single == one))[0])
                    best = (int(gains[k]), chosen, k)
        if not best[0]:
            return False
        gain, give, take = best
        taker = takers[at[take]]
        moved, returned = own_sets[give], back[take]
        self.items[giver] = [i for i in own if i not in moved] + returned
        self.items[taker] = [i for i in self.items[taker] if i not in returned] + moved
        self.fill[giver] -= gain
        self.fill[taker] += gain
        return True


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Items of each bin."""
    bins = Bins(np.asarray(lengths, dtype=np.int64), size)
    bins.best_fit()
    bins.local_search()
    return [b for b in bins.items if b]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 2, size: int = SEQUENCE) -> DataFrame:
    """Tokenised pieces (doc_id, piece, start, length, ids_crc32, nth) of `docs` (doc_id, text); null text: empty.

    `nth` counts equal documents within an input partition.
    """
    docs = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = tokenizer(path or _default_path()), Counter()
        for batch in batches:
            rows, table = [], []
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                mark = (doc, len(ids), zlib.crc32(ids.tobytes()))
                nth, seen[mark] = seen[mark], seen[mark] + 1
                for k, (start, part) in enumerate(cut(ids, size)):
                    rows.append(row)
                    table.append((k, start, len(part), zlib.crc32(part.tobytes()), nth))
            values = np.array(table, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(values[:, 0].astype(np.int32)), *[pa.array(values[:, i]) for i in (1, 2, 3, 4)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"],
            )

    return docs.mapInArrow(run, schema)


def _packer(size: int, depth: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs a group's pieces; poor sequences stay without a number unless this is the last round or they did not gain.

    `was` is the fill of the sequence a piece was in before, `turn` its place in the group.
    """

    def run(table: pa.Table) -> pa.Table:
        lengths, was = table.column("length").to_numpy(), table.column("was").to_numpy()
        sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        fill = np.zeros(len(lengths), dtype=np.int64)
        first = (depth << 58) + (int(table.column("grp")[0].as_py()) << 24)
        for number, items in enumerate(pack(lengths, size)):
            fill[items] = lengths[items].sum()
            if last or fill[items[0]] >= POOR * size or fill[items[0]] <= was[items].max():
                sequence[items] = first + number
                offset[items] = np.cumsum(lengths[items]) - lengths[items]
        kept = table.drop_columns(["was", "turn"])
        added = [pa.array(fill), pa.array(np.arange(len(lengths))), pa.array(sequence, mask=sequence < 0), pa.array(offset)]
        return pa.table([*kept.columns, *added], names=[*kept.column_names, "was", "turn", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, size: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are dealt by hash to groups of about `group_rows`, equal ones too; each group is packed by best fit and
    local search. Sequences filled less than POOR are taken apart and dealt anew, to groups of at most about FAN_IN times
    `group_rows`, as long as their fill rises; when one group is left, or a round has left more than half of its pieces,
    the next round closes all where they are. Null and empty texts are the end id alone. Rows with the same doc_id are documents of their own;
    null ids stay null. An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_rows))
    slot = F.xxhash64("doc_id", "start", "length", "ids_crc32", F.floor(F.col("nth") / 256))
    level = pieces(docs, path, end_id, size).withColumn("grp", F.pmod(slot, F.lit(groups))).drop("nth")
    level = level.withColumns({"was": F.lit(0).cast("long"), "turn": F.lit(0).cast("long")})
    schema = T.StructType([*level.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    done, depth, last, before = [], 0, groups == 1, None
    while True:
        packed = saved(level.groupBy("grp").applyInArrow(_packer(size, depth, last), schema), "packing")
        done.append(packed.where("sequence_id is not null"))
        if last:
            break
        level = packed.where("sequence_id is null").drop("sequence_id", "offset")
        left, depth = level.count(), depth + 1
        if not left:
            break
        groups = -(-left // (FAN_IN * group_rows))
        last = groups == 1 or (before is not None and left > before / 2)
        before = left
        level = level.withColumn("grp", F.pmod(F.xxhash64(F.lit(depth), "grp", "turn"), F.lit(groups)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("grp", "was", "turn")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(load(spark, folder, "documents"))
