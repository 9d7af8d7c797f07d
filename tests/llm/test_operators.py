"""Operators of the subpackage against plain versions, on small tables with the awkward rows in them."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from tracewell.llm import search
from tracewell.llm.common import DROP_SHUFFLES, bucketed, saved
from tracewell.llm.html import extract, extract_pages
from tracewell.llm.language import certain_sums, fit, label_rows, marginal_sums, training_windows
from tracewell.llm.lines import _bands, _hashes, line_groups, without_repeated_lines
from tracewell.llm.lm import backoff_scores
from tracewell.llm.mixing import mix_sources, mixed_documents
from tracewell.llm.neighbours import nearest
from tracewell.llm.ngram_join import one_of_each, shortest_prefix, similar_documents
from tracewell.llm.packing import cut, pack, pack_documents, tokenizer
from tracewell.llm.repeats import remove_repeats
from tracewell.llm.search import top_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, __key int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS) + (chance.choice("abcdefgh") * 2 if chance.random() < 0.7 else "") for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls in all columns, empty and blank texts, a long one, ties, repeated rows and ids, near copies."""
    base, long = prose(1, 120), "\n".join(prose(100 + i, 40) for i in range(120))
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, long), (None, prose(2, 50)), (None, None), (8, "one"),
        (9, "one"), (10, "two words"), (11, prose(3, 80)), (12, prose(4, 80)), (12, prose(5, 30)), (13, "é" * 500 + "\n" + prose(6, 10)), (100, prose(3, 79)),
    ]
    return [(i, t, (None, "en", "de")[k % 3], (None, "s1", "s2", "s10")[k % 4], None, 7, 8) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text):
    return (text or "").encode().split()


def test_backoff(docs, empty):
    got = Counter(tuple(None if x is None else round(x, 6) for x in r) for r in backoff_scores(docs).select("doc_id", "n_words", "n_found", "score").collect())
    texts = [(r[0], split_words(r[1])) for r in awkward()]
    one, two = Counter(w for _, ws in texts for w in ws), Counter(p for _, ws in texts for p in zip(ws, ws[1:]))
    total, expected = sum(one.values()), Counter()
    for doc, ws in texts:
        own, own2, score, found = Counter(ws), Counter(zip(ws, ws[1:])), 0.0, 0
        for i, w in enumerate(ws):
            if i and two[ws[i - 1], w] > own2[ws[i - 1], w]:
                found += 1
                score += math.log((two[ws[i - 1], w] - own2[ws[i - 1], w]) / (one[ws[i - 1]] - own[ws[i - 1]]))
            else:
                rest = total - len(ws)
                score += math.log((one[w] - own[w]) / rest if one[w] > own[w] else 1 / (rest + 1)) + (math.log(0.4) if i else 0)
        expected[doc, len(ws), found, round(score, 6)] += 1
    assert got == expected
    assert backoff_scores(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r[0], r[3]) for r in awkward())
    sizes = defaultdict(int)
    for r in awkward():
        sizes[r[3]] += len(split_words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, stopped = {}, set()
    while True:  # share out, stop what is above, share the rest again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in order if x not in stopped) for s in order}
        above = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not above:
            break
        stopped |= above
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        assert r.size == 0 or abs(r.copies - r.target / r.source_size) < 1 + 1e-9
    assert sorted(rows, key=str) == sorted(mix_sources(docs.repartition(5)).collect(), key=str)
    copies = Counter()
    for r in rows:
        copies[r.doc_id, r.source, r.size] += r.copies
    mix = mixed_documents(docs)
    assert mix.columns == docs.columns
    assert Counter((r.doc_id, r.source, len(split_words(r.text))) for r in mix.collect()) == +copies
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_mixing_comes_near_targets_with_a_hot_source(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 200)), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 200, r


def test_mixing_meets_targets_where_one_document_is_half_its_source(spark):
    rows = [(i, " ".join(["w"] * (5 + i * 13 % 60)), "abc"[i % 3]) for i in range(900)]
    rows += [(1000, " ".join(["w"] * 10_000), "a"), (None, "w " * 4000, "b"), (None, None, None), (1001, "w " * 300, None), (1001, "w " * 300, None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == 0 or abs(r.copies - r.target / r.source_size) < 1 + 1e-9
    # The source of two equal rows can only take multiples of their size.
    assert all(abs(taken[s] - t) <= (150 if s is None else 0.005 * t) for s, t in target.items()), (taken, target)
    again = mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixing_meets_targets_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mix_sources(docs).groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 0.005 * r.target, r


def test_equal_keys_with_different_texts_are_mixed_alike_in_every_run(spark):
    rows = [(1, f"w{i} x", "a") for i in range(9)] + [(2, "y " * 40, "b"), (3, "z " * 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(mixed_documents(docs).collect()) == Counter(mixed_documents(docs.repartition(4, "text")).collect())


def test_written_steps_leave_no_shuffle_files(spark):
    """Shuffle files of a step that has been written are gone, before the driver collects any garbage; the session's setting stays as it was."""

    def shuffled() -> int:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    setting = spark.conf.get(DROP_SHUFFLES)
    rows = spark.range(5000).select((functions.col("id") % 700).alias("k"), "id").groupBy("k").agg(functions.sum("id").alias("s"))
    joined = rows.join(rows.withColumnRenamed("s", "t"), "k")
    for write in (saved, lambda df, label: bucketed(df, "k", label)):
        before = shuffled()
        made = write(joined, "tried")
        for _ in range(50):  # the files go a moment later
            if shuffled() > before:
                time.sleep(0.1)
        assert shuffled() <= before and spark.conf.get(DROP_SHUFFLES) == setting
        assert sorted((r.k, r.s, r.t) for r in made.collect()) == sorted((r.k, r.s, r.s) for r in rows.collect())


def test_search_reads_frequent_terms_only_where_they_matter(monkeypatch):
    """Two rare words are in all blocks, but never in one document: no frequent word has to be read."""
    common = [f"c{i}" for i in range(20)]
    texts = [" ".join([*common, *(["left"] if i % 64 == 3 else []), *(["right"] if i % 64 == 40 else [])]) for i in range(640)]
    batch = pa.record_batch([pa.array(range(640), pa.int64()), pa.array([t.encode() for t in texts])], names=["id", "text"])
    (made,) = search._index(1, pa.int64())(iter([batch]))
    row = made.to_pylist()[0]
    assert (row["n_docs"], row["n_words"]) == (640, 640 * 20 + 20)
    (counted,) = search._frequencies(iter([made.select(["terms", "sizes", "n_docs", "n_words"])]))
    assert sorted(counted.column("df").to_pylist()) == sorted([640] * 20 + [10, 10, 640, 640 * 20 + 20])
    piece = search.Piece(row, 20.0)
    asked = search.Terms()
    asked.add(0, " ".join([*common, "left", "right"]).encode())
    hashes, weights = asked.hashes(), np.array([0.01] * 20 + [5.0, 5.0])
    order = np.argsort(hashes)
    alone = piece.search(hashes[order], weights[order], [], 10)
    assert len(alone) == 10 and {d % 64 for _, d in alone} <= {3, 40}
    read, ranges = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, b: (lambda out: (read.append(len(out)), out)[1])(ranges(a, b)))
    other = [(-8.0, 1000 + i) for i in range(10)]
    assert piece.search(hashes[order], weights[order], other, 10) == other
    assert sum(read) < 640


def test_search_takes_queries_together(monkeypatch):
    """Scores of many queries at once are those of a plain loop, and postings are read of rare words alone."""
    texts = [prose(700 + i, 30) + (f" own{i // 3}" if i % 3 else "") for i in range(300)]
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array([t.encode() for t in texts])], names=["id", "text"])
    (made,) = search._index(1, pa.int64())(iter([batch]))
    piece = search.Piece(made.to_pylist()[0], 30.0)
    asked = [search.Terms() for _ in range(40)]
    for q, terms in enumerate(asked):
        terms.add(q, texts[q * 7].encode())
    hashes = [np.sort(terms.hashes()) for terms in asked]
    weights = [1 + (h % np.uint64(97)).astype(float) / 97 for h in hashes]
    queries = search.Queries(pa.array(range(40)), np.concatenate(hashes), np.concatenate(weights), np.array([len(h) for h in hashes]))
    monkeypatch.setattr(search, "BATCH_CELLS", 2_000)
    monkeypatch.setattr(search, "CACHE_CELLS", 700)
    read, ranges = [], search._ranges
    monkeypatch.setattr(search, "_ranges", lambda a, b: (lambda out: (read.append(len(out)), out)[1])(ranges(a, b)))
    best = [[] for _ in range(40)]
    piece.search_all(queries, best, 10)
    postings = sum(len(set(t.split())) for t in texts)
    assert sum(read) < postings
    of = {int(h): float(w) for hs, ws in zip(hashes, weights) for h, w in zip(hs, ws)}
    counted = []
    for t in texts:
        terms = search.Terms()
        terms.add(0, t.encode())
        counted.append((dict(zip(terms.hashes().tolist(), terms.times)), len(t.split())))
    for q, found in zip(queries.ids.to_pylist(), best):
        wanted = set(hashes[q].tolist())
        scores = [(-sum(of[h] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 30)) for h, n in tf.items() if h in wanted), d) for d, (tf, size) in enumerate(counted)]
        plain = sorted((round(s, 9), d) for s, d in scores if s)[:10]
        assert [d for _, d in found] == [d for _, d in plain] and np.allclose([s for s, _ in found], [s for s, _ in plain], atol=1e-8)


def test_search_in_rounds_of_queries(docs, monkeypatch):
    """Queries are dealt to rounds, not to copies of the index; the index is written once and no round moves it."""
    queries = docs.where("doc_id in (1, 2, 3, 7, 8, 11, 12, 13, 100)")
    whole = Counter(top_documents(docs, queries, 4).collect())
    written, rounds = [], []
    monkeypatch.setattr(search, "QUERY_WORDS", 60)
    monkeypatch.setattr(search, "saved", lambda df, label: (written.append(label), saved(df, label))[1])
    monkeypatch.setattr(search, "_queries", lambda df, made=search._queries: (rounds.append(made(df)), rounds[-1])[1])
    assert Counter(top_documents(docs, queries, 4).collect()) == whole
    assert len(rounds) > 3 and sorted(q for r in rounds for q in r.ids.to_pylist()) == [1, 2, 3, 7, 8, 11, 12, 13, 100]
    assert written.count("index") == 1 and written.count("found") == len(rounds)


def test_search(docs, empty):
    texts = [(r[0], split_words(r[1])) for r in awkward()]
    df, number = Counter(w for _, ws in texts for w in set(ws)), len(texts)
    average = sum(len(ws) for _, ws in texts) / number
    got = defaultdict(list)
    for r in top_documents(docs, docs.where("doc_id in (1, 8, 11, 100) or doc_id is null"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    assert set(got) == {1, 8, 11, 100}
    for query, found in got.items():
        asked = {w for d, ws in texts if d == query for w in ws}
        scores = []
        for d, ws in texts:
            tf = Counter(ws)
            s = sum(math.log(1 + (number - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in asked if w in tf)
            if s > 0:
                scores.append((-round(s, 9), d is None, d or 0))
        best = sorted(scores)[:4]
        assert [(r, d or 0) for r, d, _ in found] == [(k + 1, d) for k, (_, _, d) in enumerate(best)]
        assert np.allclose([s for _, _, s in found], [-s for s, _, _ in best], atol=1e-8)
    assert top_documents(empty, empty).count() == 0


def test_html(spark):
    page = (
        "<!doctype html><html><head><title>T</title><script>var a='</p>';</script></head><body class='no-sidebar'><div class='header'>Site</div>"
        "<nav><ul><li><a href=/a>Home</a></ul></nav><div id=main class='post-12 content'><h2>A &lt;b&gt;</h2><p>One&nbsp;two\n three<br>four <b>bold"
        "<p>Second &amp;amp; more text here to be the longest part of the page.<table><tr><td>x<td>y</table><div class='comments'><p>Reader says so much that it is "
        "longer than anything else on this page, and even longer than that, and then some more of it</p></div></div>"
        "<aside>Side</aside><div class='cookie-notice'>Cookies</div><form>Search <button>go</button></form><footer>&copy;</footer>"
    )
    text, path = extract(page, [])
    assert text.split("\n\n") == ["A <b>", "One two three four bold", "Second &amp; more text here to be the longest part of the page.", "x", "y"]
    assert path.endswith("div.content.post-N")
    assert extract("", []) == ("", "") and extract("<p>", [])[0] == "" and extract("a < b & c", [])[0] == "a < b & c"
    assert extract("<article><p>cut off here &am", [])[0] == "cut off here &am"
    rows = [(k, f"http://h{k % 2}.example/{k}", page, "x") for k in range(6)] + [(6, None, page, "x"), (7, "nonsense", "", "x"), (None, "http://h0.example", None, "x"), (0, "http://h0.example/0", page, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = extract_pages(table).collect()
    assert len(got) == 10 and {(r.text, r.n_chars) for r in got} == {(text, len(text)), ("", 0)}
    assert sum(r.text == "" for r in got) == 2
    assert extract_pages(table.limit(0)).count() == 0


def test_html_host_path_decides_where_a_page_differs(spark):
    usual = "<body><div class='story'><p>{}</p></div><div class='more'><p>short</p></div></body>"
    odd = "<body><div class='story'><p>the story, short</p></div><div class='more'><p>{}</p></div></body>"
    rows = [(k, "https://a.example/x", usual.format(prose(k, 60))) for k in range(30)] + [(99, "https://a.example/y", odd.format(prose(99, 60)))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == "the story, short" and got[3] == prose(3, 60)


def test_html_reads_all_parts_of_an_article():
    parts = [prose(k, 40) for k in range(4)]
    rows = "".join(f'<div class="row"><div class="col"><p>{p}</p></div></div>' for p in parts[:3])
    text, _ = extract(f"<body><div class='links'><a href='/'>Home</a> <a href='/b'>More</a></div><article><h1>On rows</h1>{rows}</article></body>", [])
    assert text.split("\n\n") == ["On rows", *parts[:3]]
    text, _ = extract(f"<body><div><section class='a'><p>{parts[0]}</p><p>{parts[1]}</p></section><section class='b'><p>{parts[2]}</p></section></div></body>", [])
    assert text.split("\n\n") == parts[:3]


def test_forward_backward():
    chance = np.random.default_rng(4)
    lengths = np.array([0, 1, 31, 32, 33, 200, 0])
    emission, transitions = chance.random((lengths.sum(), 3)) + 1e-3, chance.normal(size=(3, 3))
    got, at = marginal_sums(emission, lengths, transitions), 0
    for row, n in enumerate(lengths):
        forward, now, backward, total, highest = [], np.ones(3), np.ones(3), np.zeros(3), 0.0
        for e in emission[at : at + n]:
            now = now @ np.exp(transitions) * e
            now = now / now.sum()
            forward.append(now)
        for i in range(n - 1, -1, -1):
            both = forward[i] * backward
            total += both / both.sum()
            highest += (both / both.sum()).max()
            backward = np.exp(transitions) @ (emission[at + i] * backward)
            backward = backward / backward.sum()
        assert np.allclose(got[row], total) and np.isclose(certain_sums(emission, lengths, transitions)[1][row], highest)
        at += n


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(training_windows(table.where("doc_id % 4 != 2")))
    right = label_rows(table.where("doc_id % 4 = 2"), model).selectExpr("avg(cast(lang = lang_pred as int)) as a", "min(score) as s", "max(score) as t").first()
    assert right.a > 0.98 and right.s > 0 and right.t <= 1
    mixed = [(1, "the of and with " * 9 + "der die und nicht " * 3), (2, "12 345 !!"), (3, None), (4, ""), (5, "x" * 100_000), (None, "²³ 漢字")]
    got = {r.doc_id: r for r in label_rows(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == "en" and 0.6 < got[1].score < 0.9
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (2, 3, 4))
    assert got[5].lang_pred in model.languages and got[None].lang_pred in model.languages
    assert label_rows(empty, model).count() == 0 and label_rows(docs, model).count() == len(awkward())
    sure = {r.doc_id: r for r in label_rows(spark.createDataFrame(mixed, "doc_id long, text string"), model, certainty_name="sure").collect()}
    assert all((r.lang_pred, r.score) == tuple(got[d])[-2:] and r.score <= r.sure <= 1 for d, r in sure.items())
    assert sure[1].sure > 0.9 and sure[2].sure == sure[3].sure == 0
    none = fit(training_windows(empty))
    assert {r.lang_pred for r in label_rows(docs, none).collect()} == {"und"}


def shingle_set(line: str) -> set:
    return {line} if len(line) < 8 else {line[i : i + 8] for i in range(len(line) - 7)}


def test_lines(spark, docs, empty):
    base = [prose(k, 30) for k in range(6)]
    texts = [
        (1, "\n".join([base[0], "", base[1], "short", base[2]])),
        (2, "\n".join([base[0] + "!", base[3], "short", "   ", base[1].replace("a", "o", 2)])),
        (3, "\n".join(base[2:5])), (4, None), (5, ""), (6, base[5][:20]), (7, base[5][:19]), (8, "ab\nab\nabc"), (None, base[4]), (9, base[0] + "?"),
    ]
    everything = texts + [(r[0] if r[0] is None else 50 + r[0], r[1]) for r in awkward()]
    table = spark.createDataFrame(everything, "doc_id long, text string")
    places = defaultdict(list)
    for doc, text in everything:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" \t\r\f\v"):
                places[line.strip(" \t\r\f\v")].append((doc is None, doc or 0, pos))
    lines, root = list(places), {k: k for k in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: shingle_set(k) for k in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    first = defaultdict(lambda: (True, math.inf, 0))
    for k in lines:
        first[find(k)] = min(first[find(k)], *places[k])
    got = line_groups(table).collect()
    assert len(got) == sum(len(t.split("\n")) for _, t in everything if t is not None)
    by_id = {d: t for d, t in everything}
    for r in got:
        if r.doc_id is None or sum(d == r.doc_id for d, _ in everything) > 1:
            continue
        line = by_id[r.doc_id].split("\n")[r.pos].strip(" \t\r\f\v")
        if not line:
            assert r.kept and r.keeper_id is None
        else:
            none, doc, pos = first[find(line)]
            assert (r.keeper_id, r.keeper_pos) == (None if none else doc, pos), (line, r)
            assert r.kept == ((r.doc_id, r.pos) == (r.keeper_id, r.keeper_pos))
    left = {r.doc_id: r.text for r in without_repeated_lines(table).collect() if r.doc_id in (1, 2, 4, 5)}
    assert left == {1: texts[0][1], 2: "\n".join([base[3], "   "]), 4: None, 5: ""}
    assert without_repeated_lines(docs).columns == docs.columns and without_repeated_lines(docs).count() == len(awkward())
    assert line_groups(empty).count() == 0 and without_repeated_lines(empty).count() == 0


def test_lines_of_a_template_meet_their_copies(spark):
    chance = random.Random(11)

    def words(n: int) -> list[str]:
        return ["".join(chance.choices("abcdefghiklmnoprstuvwyz", k=chance.randint(4, 9))) for _ in range(n)]

    template, rows = words(15), []
    for family in range(1500):
        line = " ".join(template + words(5))
        rows += [(2 * family, line), (2 * family + 1, line[:-9] + "x" + line[-8:])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    keepers = {r.doc_id: r.keeper_id for r in line_groups(table).collect()}
    sets = [shingle_set(line) for _, line in rows]
    for a in range(0, 3000, 2):
        assert len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])
    bands = defaultdict(set)
    for r in _bands(table.selectExpr("doc_id line_key", "text line")).collect():
        bands[r.line_key].add(r.band)
    lost = [a for a in range(0, 3000, 2) if keepers[a] != keepers[a + 1]]
    assert len(lost) <= 5 and not any(bands[a] & bands[a + 1] for a in lost)
    assert len(set(keepers.values())) == 1500 + len(lost)


def test_lines_alike_but_for_their_latin_tails(spark):
    chance = random.Random(3)
    body = "".join(chr(chance.randint(0x4E00, 0x9FA0)) for _ in range(1000))
    lines = [body + "".join(chance.choices("eo ", k=97)) + "end" for _ in range(2)]
    common = len(shingle_set(lines[0]) & shingle_set(lines[1]))
    assert common >= 0.8 * (len(shingle_set(lines[0])) + len(shingle_set(lines[1])) - common)
    got = line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keeper_id for r in got} == {0: 0, 1: 0}


def test_lines_with_characters_beyond_two_bytes(spark):
    chance, rows = random.Random(5), []
    for family in range(12):
        tail = "".join(chance.choices("abcdefghij ", k=99)) + "."
        rows += [(2 * family + k, "".join(chr(chance.randint(0x1F300, 0x1F5FF)) for _ in range(10)) + tail) for k in range(2)]
    rows += [(100, "kurz"), (101, "äöü" * 9), (102, "abcdefgh"), (103, "a\tb c")]
    table = spark.createDataFrame(rows, "line_key long, line string")
    for r in table.select("line", functions.size(functions.array_distinct(_hashes(functions.col("line")))).alias("n")).collect():
        assert r.n == len(shingle_set(r.line)), r
    bands = defaultdict(set)
    for r in _bands(table).collect():
        bands[r.line_key].add(r.band)
    found = [a for a in range(0, 24, 2) if bands[a] & bands[a + 1]]
    keepers = {r.doc_id: r.keeper_id for r in line_groups(table.selectExpr("line_key doc_id", "line text")).collect()}
    sets = [shingle_set(line) for _, line in rows]
    assert found and all(len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1]) for a in found)
    assert all(keepers[a] == keepers[a + 1] for a in found)


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, mine = Tokenizer.from_file(path), tokenizer(path)
    for text in ["", "a<|endoftext|> b", "  \n\n x\t\t", "漢字 emoji 😀　x", "don't I'LL 12345 ___", "a \u0085b​", prose(1, 300)]:
        assert mine(text) == theirs.encode(text, add_special_tokens=False).ids
    rows = pack_documents(docs).collect()
    expected = Counter()
    for doc, text, *_ in awkward():
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.update((doc, k, s, len(p), zlib.crc32(p.tobytes())) for k, (s, p) in enumerate(cut(ids, 1024)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == -(-sum(r.length for r in rows) // 1024)
    assert pack_documents(empty).count() == 0


def test_packing_in_several_rounds(spark):
    rows = [(i, " ".join(["word"] * (1 + i * 131 % 1400))) for i in range(600)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=16).collect()
    assert len({r.doc_id for r in got}) == 600 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.08 * total / 1024


def test_packing_of_documents_that_fit_with_no_other(spark, monkeypatch):
    most = []

    def noted(df, label):
        out = saved(df, label)
        most.append(out.groupBy("grp").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr("tracewell.llm.packing.saved", noted)
    rows = [(i, " ".join(["word"] * 600)) for i in range(3000)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=16).collect()
    assert len(got) == 3000 and len({r.sequence_id for r in got}) == 3000
    assert max(most) <= 4 * 16 * 2


def test_local_search_empties_bins():
    chance = np.random.default_rng(2)
    for _ in range(20):
        lengths = chance.integers(1, 700, 60)
        bins = pack(lengths)
        assert sorted(i for b in bins for i in b) == list(range(60)) and max(lengths[b].sum() for b in bins) <= 1024
        assert len(bins) <= math.ceil(lengths.sum() / 1024) + 2


def test_cut():
    assert [(s, len(p)) for s, p in cut(np.arange(2500), 1024)] == [(0, 452), (452, 1024), (1476, 1024)]
    assert [(s, len(p)) for s, p in cut(np.arange(2048), 1024)] == [(0, 1024), (1024, 1024)]
    assert [(s, len(p)) for s, p in cut(np.arange(1024), 1024)] == [(0, 1024)]


def ngram_set(text):
    words = split_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngram_join(spark, docs, empty):
    assert shortest_prefix(0.8, 0.999) == 4 and shortest_prefix(0.8, 0.9) == 6
    chance = random.Random(9)
    rows = [(r[0], r[1]) for r in awkward()]
    for family in range(4):  # families of near copies, some of them similar only by way of others
        words = prose(200 + family, 150).split()
        for k in range(12):
            words = list(words)
            words[chance.randrange(150)] = f"edit{family}x{k}"
            rows.append((300 + 20 * family + k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [ngram_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i], *(root[j] for j in near[i])])
    least = {r: min([rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None], default=None) for r in set(root)}
    expected = Counter((rows[i][0], rows[i][0] if not sets[i] else least[root[i]], len(near[i])) for i in range(len(rows)))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in similar_documents(table).collect()) == expected
    kept = one_of_each(table).collect()
    blank = sum(not s for s in sets)
    assert len(kept) == blank + len({root[i] for i in range(len(rows)) if sets[i]})
    assert one_of_each(docs).columns == docs.columns
    assert similar_documents(empty).count() == 0 and one_of_each(empty).count() == 0


def test_ngram_join_splits_large_groups(spark, monkeypatch):
    from tracewell.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    words = prose(7, 200).split()
    rows = [(k, " ".join([*words[:100], f"edit{k}", *words[101:]])) for k in range(40)]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_repeats(spark, docs, empty):
    passage = prose(11, 90)
    rows = [(r[0], r[1]) for r in awkward()] + [
        (20, passage), (21, "x" + passage + "y"), (22, prose(12, 30) + passage[:450] + prose(13, 30)), (23, "ab" * 400), (24, passage[:399]), (25, "q" * 3000), (26, passage[30:] + passage[:430]),
    ]
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    expected = Counter()
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone) if not g)
        expected[doc, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == expected
    assert sum(k[2] > 0 for k in expected) > 5
    assert remove_repeats(docs).count() == len(awkward()) and remove_repeats(empty).count() == 0


def test_repeats_with_hot_seeds(spark, monkeypatch):
    from tracewell.llm import repeats

    passage = prose(21, 120)
    rows = [(k, f"{prose(500 + k, 20)} {passage[k % 7 :]} {k}") for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(remove_repeats(table).collect())
    monkeypatch.setattr(repeats, "HOT_RUNS", 2)
    assert sorted(remove_repeats(table).collect()) == usual and usual[0].n_removed > 400


def test_neighbours(spark):
    chance = np.random.default_rng(5)
    vectors = chance.normal(size=(900, 16)).astype(np.float32)
    vectors[100:400] = vectors[7]  # a third of all rows are one vector
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0.5), (1050, [0.0] * 16, 0.5), (1100, [float("nan")] * 16, 0.5), (1150, [1.0] * 15 + [None], 0.5), (1200, [float("inf")] + [1.0] * 15, 0.5), (None, [1.0] * 16, 0.5), (1250, [], 0.5), (3, vectors[3].tolist(), 0.5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in nearest(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 50))
    wide, hits = vectors.astype(np.float64), 0
    norms = np.sqrt((wide * wide).sum(axis=1))
    for q, found in got.items():
        scores = (wide * wide[q]).sum(axis=1) / (norms * norms[q])
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        hits += len({v for _, v, _ in found} & set(order))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(s == scores[v] for _, v, s in found)
        if 100 <= q < 400:
            assert [v for _, v, _ in found] == [i for i in (7, 100, 101, 102, 103, 104, 105) if i != q][:5]
    assert hits >= 0.9 * 5 * len(got)
    assert nearest(table.limit(0), table.limit(0)).count() == 0
    few = nearest(table.where("vec_id in (0, 1, 2, 1000)"), table.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_neighbours_read_as_many_lists_as_recall_needs(spark, monkeypatch):
    monkeypatch.setattr("tracewell.llm.neighbours.LIST_ROWS", 8)  # 500 lists
    vectors = np.random.default_rng(7).normal(size=(4000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    found = defaultdict(set)
    for r in nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 20):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(found[q] & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.98 * 5 * 200
