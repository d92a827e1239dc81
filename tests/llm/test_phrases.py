"""Phrase mining against brute force on odd rows, with collisions and in small runs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, fp string, a int, at long, phrase string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "x", 2, 3, "y") for k, (t, lang) in enumerate(rows)], SCHEMA)


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def mined(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    scored = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored[lang, w] = (score, a, f[lang, w[:k]], f[lang, w[k:]])
    inside = set()
    for (lang, w), (_, a, *_) in scored.items():
        for n in range(2, len(w)):
            for k in range(len(w) - n + 1):
                if 100 * a >= 80 * f[lang, w[k : k + n]]:
                    inside.add((lang, w[k : k + n]))
    out, by_lang = [], {}
    for (lang, w), (score, a, l, r) in scored.items():
        if (lang, w) not in inside:
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    for lang, found in by_lang.items():
        out += [(lang, rank + 1, p.decode(), -a, l, r, total[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [*"abcdefghij", "The", "né", "日本", "O'Neill", "x" * 200, "ÉT", "\x00"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", " \x0b"]) for _ in range(n))
    out = [(prose(rng.randrange(1, 80)), rng.choice(["en", "en", "en", "de", None, "und", "new york"])) for _ in range(300)]
    out += [("new york city hall is new york city hall", "en")] * 9 + [("  ", "en"), (None, "en"), ("", None), ("?!", "zz"), ("one two", "rare")]
    out += [(prose(250_000), "long"), ("a a a a a a a a a", "en"), (" a" * 400_000, "aa")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bits,flush,run,table,top", [(64, 2_000_000, 1 << 18, 1 << 27, 2000), (9, 700, 50, 1 << 10, 40)])
def test_phrases(spark, rows, monkeypatch, bits, flush, run, table, top):
    monkeypatch.setattr(phrases, "FINGERPRINT_BITS", bits)
    monkeypatch.setattr(phrases, "FLUSH", flush)
    monkeypatch.setattr(phrases, "RUN_WORDS", run)
    monkeypatch.setattr(phrases, "FILTER_BITS", table)
    own = rows if bits == 64 else [r for r in rows if len(r[0] or "") < 100_000]
    got = phrases.collocations(documents(spark, own), 4, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(own, 4, top)


def test_empty_tables(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(None, None), ("a b", "en")])).count() == 0


def test_polynomials_are_those_of_the_words_alone():
    rng = np.random.default_rng(1)
    h, other = rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
    seeds = np.full(50, 7, np.uint64)
    whole = phrases.Grams((h, other), seeds)
    for n in range(1, 5):
        for k in (0, 11, 50 - n):
            alone = phrases.Grams((h[k : k + n], other[k : k + n]), seeds[:n])
            at, start = np.array([k]), np.array([0])
            assert whole.fingerprints(n, at) == alone.fingerprints(n, start) and whole.checks(n, at) == alone.checks(n, start)


def test_arithmetic_beyond_64_bits(spark):
    n = 10**13
    tag = lambda size: size | 8
    frame = spark.createDataFrame([(tag(2), 5, n, "en", "a b", [tag(1), 17 | 1], [1, 2])], "fp long, check long, a long, lang string, phrase string, parts array<long>, part_checks array<long>")
    lang = spark.sql("SELECT shiftleft(xxhash64('en'), 3) AS fp, 0L AS check, 3L AS n")
    counts = spark.createDataFrame([(tag(1), 1, n + 1), (17 | 1, 2, 2 * n)], "fp long, check long, n long").unionByName(lang)
    (row,) = phrases.ranked(frame, counts, 10).collect()
    assert (row.score, row.l, row.r, row.n) == (2_000_000 * n // (3 * n + 1), n + 1, 2 * n, 3)
