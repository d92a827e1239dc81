"""Every stage of the pipeline against brute force on rows with null and repeated ids, copies and odd texts."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lotwise.llm import exact_dedup, minhash

from test_text_operators import lowered, split

# names that the operators use themselves
COLUMNS = "doc_id long, text string, lang string, source string, key1 long, key2 string, size int, h long, times int, c0 string, row long, source_size long"
STAGE = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "k", 2, 3, 4, "c", 5, 6) for i, t, lang, s in rows], COLUMNS)


def through(spark, stage, rows):
    """The (doc_id, text, lang, source) rows that a stage leaves, once its columns are checked."""
    docs = frame(spark, rows)
    out = STAGE[stage](spark, docs, "")
    assert out.columns == docs.columns
    return [tuple(r)[:4] for r in out.collect()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    syllables = ["sch", "ung", "keit", "der", "ein", "und", "ist"]
    text = lambda n: " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))
    near = lambda t: t + " neu"
    out = [(k, text(30), "de", f"s{k % 3}") for k in range(40)]
    t = [r[1] for r in out]
    out += [(2, t[3], "de", "s0"), (2, near(t[4]), "de", "s1"), (2, "12 34", "de", "s1"), (5, t[3].upper(), None, "s0")]  # an id again, other texts
    out += [out[7], out[7], (7, t[7].title(), "de", "s9"), (7, near(t[7]), "de", "s0")]  # rows again
    out += [(None, t[8], "de", None), (None, t[8], "de", None), (None, text(25), "de", "s1"), (None, near(t[9]), "de", "s1"), (None, "7 8", None, None)]
    lone = text(25)
    out += [(None, lone, "de", "s2"), (None, near(lone), "de", "s2"), (None, near(lone), "de", "s2")]  # a component without ids
    out += [(100, None, "de", "s2"), (101, "", None, "s2"), (101, "", None, "s2"), (102, " \n", "de", None), (103, "ein", "de", "s0"), (104, "EIN", "de", "s0")]
    out += [(105, text(60_000), "de", "s1"), (106, "x" * 200_000, "de", "s1")]
    rng.shuffle(out)
    return out


def test_language(spark, rows):
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(through(spark, "language", rows)) == Counter(want)


def least(ids):
    return min((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("support", [0.001, 0.06])
def test_exact(spark, rows, monkeypatch, support):
    monkeypatch.setattr(exact_dedup.classed, "__kwdefaults__", {"support": support})
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r)
    got = through(spark, "exact", rows)
    assert len(got) == len(groups) and not Counter(got) - Counter(rows)
    for r in got:
        group = groups.pop(lowered(r[1]))
        assert r[0] == max((g[0] for g in group if g[0] is not None), default=None)


@pytest.mark.parametrize("small,block", [(48, 1024), (0, 3)])
def test_near(spark, rows, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL_GROUP", small)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    sets = []
    for r in rows:
        w = split(lowered(r[1]))
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    parts = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(i)
    got = through(spark, "near", rows)
    left = Counter(got)
    assert not left - Counter(rows)
    for part in parts.values():
        mine = Counter(rows[i] for i in part)
        stays = sum((left & mine).values())
        assert stays == 1
        ids = [r[0] for r in (left & mine)]
        assert ids == [least(rows[i][0] for i in part)]
        left -= left & mine
    assert not left


def test_shingles_of_other_sizes(spark, rows):
    some = [r for r in rows if len(r[1] or "") < 2000]
    for size in (1, 5):
        got = minhash.near_duplicates(frame(spark, some), size=size).collect()
        count = lambda w: len({tuple(w[k : k + size]) for k in range(len(w) - size + 1)}) if len(w) > size else int(bool(w))
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((r[0], count(split(lowered(r[1])))) for r in some)


def test_mix(spark, rows):
    got = Counter(through(spark, "mix", rows))
    held = Counter(rows)
    words = lambda r: len(split(r[1] or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r)
    assert not set(got) - set(held)
    for r, n in held.items():
        assert got[r] == n if not words(r) else got[r] <= 3 * n and got[r] % n == 0
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weights[s] for s in sizes if s not in capped) or 1)
        over = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        target = 3 * sizes[s] if s in capped else level * weights[s]
        biggest = max(words(r) * held[r] for r in held if r[3] == s)
        assert abs(sum(words(r) * n for r, n in got.items() if r[3] == s) - target) <= biggest


def test_tokens(spark, rows):
    import hashlib

    got = STAGE["tokens"](spark, frame(spark, rows), "").collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want


def test_empty_tables_pass(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)


def test_run(spark, rows, tmp_path):
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, "")).collect(), out.schema)
    assert Counter(map(tuple, got)) == Counter(map(tuple, docs.collect()))
