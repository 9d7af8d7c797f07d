"""Hard negatives, ranked search and benchmark passages against plain versions, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import negatives
from tracewell.llm.decontaminate import gram_hashes, op13, shared_passages, winnowed, words_of
from tracewell.llm.negatives import hard_negatives, strassen
from tracewell.llm.ranked import Piece, ranked_documents

DOCS = "doc_id long, text string, item_id int, query long, window string"
ITEMS = "item_id int, text string, doc_id int, `from` int, salt string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_strassen_is_exact_on_odd_shapes_and_when_sums_wrap():
    chance = np.random.default_rng(1)
    for shape in [(1, 1, 1), (17, 17, 17), (40, 64, 33), (65, 3, 70), (33, 100, 35), (0, 20, 20), (50, 50, 50)]:
        for most in (5, 1 << 28):
            a, b = chance.integers(-most, most, shape[:2]), chance.integers(-most, most, shape[1:])
            assert (strassen(a, b) == a @ b).all(), shape
    a = np.full((40, 40), 1 << 62)  # quarters add up beyond 64 bits, the product does not
    assert (strassen(a, np.eye(40, dtype=np.int64)) == a).all()


def plain_negatives(rows, positives, negatives_, low, high):
    def usable(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1]) and sum(math.floor(256 * x) ** 2 for x in r[1]) < 1 << 62

    fine = {(r[0], tuple(math.floor(256 * x) for x in r[1]), r[2]) for r in rows if usable(r)}
    out = Counter()
    for a in fine:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in fine)
        for s, positive in [(-s, i) for s, i, label in scored if label == a[2] and i != a[0]][:positives]:
            window = [(-n, i) for n, i, label in scored if label != a[2] and low * s <= 100 * -n <= high * s][:negatives_]
            out.update((a[0], positive, k + 1, i, s, n) for k, (n, i) in enumerate(window))
    return out


@pytest.mark.parametrize("tile", [(512, 2048), (3, 4)])
def test_hard_negatives(spark, monkeypatch, tile):
    chance = random.Random(3)
    rows = [(i, [chance.gauss(0.6 if i % 3 else -0.2, 1) for _ in range(5)], i % 3 if i % 4 else 0, "x") for i in range(160)]
    rows += [(i, [1.0, 0.5, 0, 0, 0], 1, None) for i in range(200, 240)]  # ties
    rows += [(250, [1.0, 0.5], 1, None), (250, [1.0, 0.5], 1, None), (250, [0.9, 0.5, 0.1], 2, None), (251, [], 1, None), (300, [], 1, None)]
    rows += [(None, [1.0], 1, None), (400, None, 1, None), (450, [1.0, None], 1, None), (500, [float("nan")], 1, None), (550, [float("inf")], 1, None)]
    rows += [(600, [1.0], None, None), (650, [1e30, 1.0], 1, None), (-50, [0.8, 0.7, 0.1, 0, 0], 1, None), (700, [1e5, -3e4, 2.5e4], 2, None), (701, [9e4, 3e4, 2e4], 2, None), (702, [4e4] * 3, 1, None)]
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 200)  # several blocks of both sides
    monkeypatch.setattr(negatives, "ROW_BYTES", 1500)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", tile[0])
    monkeypatch.setattr(negatives, "TILE_ROWS", tile[1])
    rows = [(i, v and [x if x is None else float(x) for x in v], label, t) for i, v, label, t in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, uid string")
    for args in [(5, 3, 50, 95), (2, 4, -10, 101)]:
        got = Counter(tuple(r) for r in hard_negatives(table, table["vec_id"] % 50 == 0, *args).collect())
        assert got == plain_negatives(rows, *args)
        assert got
    assert hard_negatives(table.limit(0), table["vec_id"] % 50 == 0).count() == 0
    one_label = table.where("label = 1")
    assert hard_negatives(one_label, one_label["vec_id"] % 50 == 0).count() == 0


def library(documents, seed):
    chance = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [" ".join(chance.choice(common if chance.random() < 0.8 else rare) for _ in range(chance.randint(1, 60))) for _ in range(documents)]
    rows = [(i, t, 5, 6, "w") for i, t in enumerate(texts)]
    rows += [(7, texts[8], None, None, None), (9, texts[8], None, None, None), (9, texts[8], None, None, None), (None, texts[8], None, None, None), (900, None, None, None, None), (901, "", None, None, None)]
    return rows + [(902, " \t-- !", None, None, None), (903, "C1, É1é r5 " * 3000, None, None, None), (904, "Éa  b", None, None, None)]


def test_ranked_documents(spark, monkeypatch):
    rows = library(700, 5)
    items = [(1, "c1 C1 r5-r6", 3, 4, "x"), (2, "c0 c1 c2 c3 c4 r1 r2 r3", None, None, None), (3, None, None, None, None), (4, "nowhere", None, None, None), (None, "c1", None, None, None)]
    items += [(5, "É1É Éa é1é", None, None, None), (6, "", None, None, None), (7, "r7", None, None, None), (7, "c3", None, None, None)]
    table, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    counts = [(r[0], Counter(terms(r[1]))) for r in rows]
    held = [c for _, c in counts if c]
    number, total, df = len(held), sum(sum(c.values()) for c in held), Counter(w for c in held for w in c)
    wanted = defaultdict(set)
    for i, t, *_ in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    expected = []
    for item, ws in wanted.items():
        scores = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * number // total
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            if s > 0:
                scores.append((-s, doc is None, doc))
        expected += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:10])]
    for words in (3_000_000, 2_000):
        monkeypatch.setattr("tracewell.llm.ranked.PIECE_WORDS", words)
        got = [tuple(r) for r in ranked_documents(table.coalesce(2), asked).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert ranked_documents(table.limit(0), asked).count() == 0 and ranked_documents(table, asked.limit(0)).count() == 0


def test_ranked_documents_skip_spans():
    """A strong short list raises the bar, and most spans of the long lists are never looked into."""
    spots, looked = np.arange(6400), []

    class Values(np.ndarray):
        def __getitem__(self, key):
            looked.append(key)
            return np.asarray(self)[key]

    piece = Piece.__new__(Piece)
    piece.ids, piece.spans = list(range(6400)), 100
    rare = np.array([50, 3000, 6000])
    piece.lists = lambda hashes, weights: [(rare, np.array([900, 950, 990])), (spots, np.full(6400, 10).view(Values)), (spots, (spots % 7).view(Values))]
    best = piece.search(None, None, [], 3)
    assert best == [(-990 - 10 - 6000 % 7, 6000), (-950 - 10 - 3000 % 7, 3000), (-900 - 10 - 50 % 7, 50)]
    assert sum(isinstance(k, slice) for k in looked) <= 6


def plain_passages(docs, items, span=10):
    windows = defaultdict(set)
    for item, text, *_ in items:
        ws = terms(text)
        n = min(span, len(ws))
        if item is not None and n:
            for i in range(len(ws) - n + 1):
                windows[tuple(ws[i : i + n])].add(str(item))
    out = []
    for doc, text, *_ in docs:
        ws, hit, found = terms(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_shared_passages(spark, tmp_path):
    chance = random.Random(8)
    word = lambda: chance.choice("ab cd ef gh ij kl mn op qr st".split())
    items = [(i, " ".join(word() for _ in range(n)), 1, 2, "s") for i, n in enumerate([9, 10, 11, 25, 40, 3, 1, 10, 12, 30])]
    items += [(3, "Other words Of the same item, and again Some more", None, None, None), (20, None, None, None, None), (21, "", None, None, None), (22, "!!", None, None, None)]
    items += [(30, "same " * 15, None, None, None), (31, "SAME " * 10, None, None, None), (None, "nobody asks for any of these words at all here today", None, None, None), (4, items[4][1], None, None, None)]
    docs = []
    for i in range(300):
        ws = [word() for _ in range(chance.randint(0, 60))]
        for _ in range(chance.randint(0, 3)):
            source = chance.choice(items)[1] or ""
            part = terms(source)
            cut = chance.randint(0, max(0, len(part) - 5))
            at = chance.randint(0, len(ws))
            ws[at:at] = part[cut : cut + chance.randint(1, 30)]
        docs.append((i, ", ".join(ws).title() if i % 3 else " ".join(ws), 5, 6, "w"))
    docs += [(1, docs[2][1], None, None, None), (1, docs[2][1], None, None, None), (None, docs[3][1], None, None, None), (500, None, None, None, None), (501, "", None, None, None)]
    docs += [(502, "same " * 3000, None, None, None), (503, "x" * 100_000, None, None, None), (504, "nobody asks for any of these words at all here today", None, None, None)]
    docs += [(600 + i, items[4][1], None, None, None) for i in range(500)]  # copies of one passage
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in op13(spark, str(tmp_path)).collect())
    assert got == plain_passages(docs, items)
    documents, benchmark = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    found, sets = shared_passages(documents, benchmark)
    whole = found.where("doc_id >= 600").join(sets, "item_set").selectExpr("spans", "items").distinct().collect()
    assert len(whole) == 1 and [tuple(s) for s in whole[0].spans] == [(0, 40)] and "4" in whole[0].items
    assert shared_passages(documents.limit(0), benchmark)[0].count() == 0
    none = shared_passages(documents, benchmark.limit(0))[0]
    assert none.count() == len(docs) and none.where("size(spans) > 0 or item_set is not null").count() == 0


def test_winnowing_keeps_a_print_of_every_shared_span(monkeypatch):
    chance = np.random.default_rng(2)
    one, two = chance.integers(0, 50, 400).astype(np.uint64), chance.integers(0, 50, 300).astype(np.uint64)
    two[100:110] = one[200:210]
    (a, grams), (b, others) = winnowed(one, 10, 5), winnowed(two, 10, 5)
    assert set(grams[a[200:201]]) == set(others[b[100:101]]) and len(set(a.tolist())) < 200
    assert len(gram_hashes(one[:3], 5)) == 0 and len(winnowed(one[:9], 10, 5)[0]) == 0
    text = ("Some words, é漢字 " * 50 + "y" * 70).encode()
    whole = words_of(text)
    monkeypatch.setattr("tracewell.llm.decontaminate.CHUNK", 60)
    parts = words_of(text)
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and len(parts[0]) == len(parts[1])
