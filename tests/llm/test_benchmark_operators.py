"""Decontamination and lexical search against brute force on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import decontam, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VOCABULARY = [*"abcdefgh", "the", "né", "日本", "x1", "ÉT"]


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, [], "x", 0) for i, t in rows], "doc_id long, text string, source string, n_words int, spans array<int>, item string, key1 long")


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "item_id long, text string, doc_id int, n int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    prose = lambda n: rng.choice([" ", ", ", "--", "\n"]).join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(k, prose(rng.randrange(1, 30))) for k in range(40)]
    items += [(3, "again the same item"), (None, "an item without a name"), (None, prose(12)), (50, None), (51, " .,"), (52, "the"), (53, "a a a a a a a a a a a a"), (54, "two words")]
    texts = [prose(rng.randrange(1, 200)) for _ in range(60)] + [None, "", " ?!", "the", "two", "Two-WORDS", "a " * 9, "a " * 11, "an item without a name " * 2]
    texts += [f"{prose(20)} {rng.choice(items)[1]} {prose(5)}" for _ in range(30)]
    texts += [items[0][1].upper()] * 4 + [prose(260_000) + " " + items[5][1], "é" * 300_000 + " two words"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[2]), (1, texts[1]), (None, texts[3])]
    rng.shuffle(rows)
    return rows, items


def contaminated(rows, items):
    windows = {}
    for i, text in items:
        w = terms(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    out = []
    for i, text in rows:
        w, hit, found = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination(spark, corpus, block_bytes):
    rows, items = corpus
    got = decontam.contamination(documents(spark, rows), benchmark(spark, items), block_bytes)
    want = contaminated(rows, items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 20 < sum(r[-1] for r in want) < len(want)


def test_nothing_to_decontaminate(spark, corpus):
    rows, items = corpus
    none = decontam.contamination(documents(spark, rows[:5]), benchmark(spark, []))
    assert [r.n_hit for r in none.collect()] == [0] * 5
    assert decontam.contamination(documents(spark, []), benchmark(spark, items)).count() == 0


def test_prefix_is_the_rarest_shingle():
    words = np.array([5, 6, 7, 8], np.uint64)
    windows = decontam.Windows(["a"], [words])
    (grams,) = windows.vocabulary().values()
    rare = decontam.shingles(words, 3)
    counts = {int(g): 9 for g in grams.view(np.int64)} | {int(rare.view(np.int64)[1]): 2}
    ((length, size, tokens, cuts, rows, places),) = windows.prefixes(counts)
    assert (length, size, list(tokens), list(places)) == (4, 3, [rare[1]], [1])


def ranked(rows, items, top=20):
    docs = [(i, terms(t)) for i, t in rows if t is not None]
    docs = [(i, len(w), Counter(w)) for i, w in docs if w]
    n_all, l_all = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for *_, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, n, c in docs:
            m = 75 + (25 * n * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("docs,leaf,block_terms", [(2048, 16, 1 << 16), (7, 2, 20)])
def test_lexical_search(spark, corpus, monkeypatch, docs, leaf, block_terms):
    monkeypatch.setattr(lexical, "TREE_DOCS", docs)
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    rows, items = corpus
    got = lexical.search(documents(spark, rows), benchmark(spark, items), block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items)


def test_nothing_to_search(spark, corpus):
    rows, items = corpus
    assert lexical.search(documents(spark, rows[:3]), benchmark(spark, [])).count() == 0
    assert lexical.search(documents(spark, []), benchmark(spark, items)).count() == 0
    assert lexical.search(documents(spark, [(1, None), (2, " ")]), benchmark(spark, items)).count() == 0


def test_trees_share_paths_and_leave_out_branches():
    rng = np.random.default_rng(4)
    tf = (rng.random((2000, 60)) < np.geomspace(0.95, 0.004, 60)).astype(np.int32) * rng.integers(1, 5, (2000, 60), dtype=np.int32)
    m = rng.integers(80, 300, 2000)
    tree = lexical.Tree(tf, m)
    leaves = [k for k, below in enumerate(tree.children) if below is None]
    covered = sorted(d for k in leaves for d in range(tree.first[k], tree.stop[k]))
    assert covered == list(range(2000)) and sorted(tree.order) == covered
    for node in range(len(tree.first)):
        part = slice(tree.first[node], tree.stop[node])
        assert (tree.maxima[node] == tree.tf[part].max(axis=0)).all() and tree.least_m[node] == tree.m[part].min()
    terms_, weights = np.array([3, 40, 50, 58]), np.array([50, 3000, 4000, 6000])
    whole = np.sort(lexical.scores(tf[:, terms_], m, weights))[::-1]
    best, seen = lexical.Best(20), []

    def enough(rows, got):
        if rows is not None:
            seen.extend(rows)
            best.take(got, rows, np.zeros(len(rows), np.int64))
        return best.least()

    tree.search(terms_, weights, enough)
    assert list(best.score) == list(whole[:20])
    assert len(seen) < 1000


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 3], np.int64)
    assert list(lexical.lengths(n, 10**11, 10**15)) == [75 + 25 * 10**9 * 10**11 // 10**15, 75]
