"""Exact dedup, near dedup, mixing, tokens, language, toxicity and personal data against brute force."""

import base64
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lotwise.llm import bpe, exact_dedup, langid, minhash, mixing, pii, toxicity
from lotwise.llm.common import text_words

DOCS = "doc_id long, text string, lang string, source string, keep_id long, key string, size int"
WORDS = "the of and to in is that it was for on are as with his they be at one have this from or had by not word but what some we can out other were all there when up use your how said an each she".split()


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, lang, s, -1, "k", 7) for i, t, lang, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    for base in texts[:12]:
        for _ in range(rng.randrange(1, 6)):
            words = base.split()
            for _ in range(rng.randrange(0, 1 + len(words) // 9)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
    texts += [None, "", " \t\n", "one", "ONE", "Élan", "élan", "x" * 3000, prose(rng, 9000)] + ["same text here"] * 30
    rng.shuffle(texts)
    return [(k, t, "en", ["a", "b", None, "é"][k % 4 if k % 7 else 0]) for k, t in enumerate(texts)] + [(2, texts[2], "en", "b")]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


@pytest.mark.parametrize("support", [0.05, 0.5])
def test_exact_dedup(spark, rows, support):
    got = exact_dedup.exact_dedup(frame(spark, rows), support=support).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, *_ in rows for g in [groups[lowered(t)]])
    assert sorted(map(tuple, got)) == want
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == frame(spark, []).columns and {r.doc_id for r in left.collect()} == {max(g) for g in groups.values()}


def components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = split(lowered(t))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_links_do_not_depend_on_the_size_of_a_group(spark, monkeypatch):
    """A pair in a group of 10 and one in a group of 100 link by the same rule, whichever way they are compared."""
    rng = random.Random(31)
    texts = []
    for size in (10, 100):
        base = [f"{rng.choice(WORDS)}{k}" for k in range(80)]
        for _ in range(size):  # similarity around the threshold, matches around the least number
            words = base[:]
            for _ in range(rng.randrange(2, 9)):
                words[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    for matches in (34, 52):  # at 52 of 64 many similar pairs have too few
        monkeypatch.setattr(minhash, "MATCHES", matches)
        monkeypatch.setattr(minhash, "PREFIX", minhash.COORDS - matches + 1)
        found = []
        for small in (10**9, 48, 0):
            monkeypatch.setattr(minhash, "SMALL_GROUP", small)
            found.append(sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()))
        assert found[0] == found[1] == found[2]
        assert 2 < len({c for _, c in found[0]}) < 110


@pytest.mark.parametrize("small,block", [(48, 1024), (0, 3)])
def test_near_duplicates(spark, rows, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL_GROUP", small)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    want = components(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_word_hashes_do_not_depend_on_chunks():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [prose(rng, 300), None, "", "Ab aB\x0bcd", "ß é\xa0x", prose(rng, 2000)]
    once = [w.tolist() for _, w in text_words(pa.array(texts))]
    assert once == [w.tolist() for _, w in text_words(pa.array(texts), piece_bytes=64)]
    assert [len(w) for w in once] == [len(split(t or "")) for t in texts] and once[3][0] == once[3][1]


def test_mixing(spark, rows):
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes, total = {}, 0
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t or ""))
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = Fraction(rest, sum(weights[s] for s in sizes if s not in capped) or 1)
        over = {s for s in sizes if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else float(level * weights[s]) for s in sizes}
    source = {i: s for i, _, _, s in rows}
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id] if r.doc_id != 2 else next(k for k in sizes if sizes[k] == r.source_size)
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    biggest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= biggest for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(frame(spark, rows[::-1])).collect()))


def test_tokens_match_the_library(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = ["a" * 5000, "日本語テキスト" * 300, "I'll don't  \n\n x\x1cy\x85 12345", "🙂👩‍👩‍👧 ok", "".join(random.Random(3).choice("abcde") for _ in range(3000))]
    texts = rows + [(1000 + k, t, None, None) for k, t in enumerate(odd)]
    t = bpe.Tokenizer(spark)
    got = {r.doc_id: r for r in t.decode(t.encode(frame(spark, texts))).collect()}
    for i, text, *_ in texts:
        want = encoding.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, dtype="<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (text or "").encode()
    assert bpe.round_trip(frame(spark, [])).count() == 0


def test_base_personal_data(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    rng = random.Random(9)
    texts = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255", "🙂 é +1 (555) 123-4567 4111 1111 1111 1111 🙂a@b.co", "1" * 5000, "1." * 900, "a@" * 900, "é 4111111111111111 " * 700, "@@..@a.b-c.d@e"]
    texts += ["".join(rng.choice("1234567890 .-+()@ab") for _ in range(400)) for _ in range(60)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if holds(kind, m.group()))
        want = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_contexts_find_more_personal_data(spark):
    rng, cards = random.Random(2), []
    while len(cards) < 30:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0:
            cards.append(d)
    texts = [f"please charge card number {c} today" for c in cards] + ["please charge card number AX-77-19. Thanks", "the year 1999 was good", "room 12 is free"]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_found for r in rows] == [0] * 30 + [1, 0, 0]
    at = texts[30].index("AX-77-19")
    assert rows[30].spans == f"id:{at}:{at + 8}"


def found_ids(spark, texts):
    """The found spans of each text, as what they cover."""
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    spans = [[s.split(":") for s in r.spans.split(",") if s.startswith("id:")] for r in rows]
    assert [r.n_found for r in rows] == [len(s) for s in spans]
    return [[t[int(a) : int(b)] for _, a, b in s] for t, s in zip(texts, spans)]


def test_contexts_of_every_kind_of_base_span(spark):
    phones = [f"you can phone home {p} today" for p in (f"+1 (521) 555-{k}" for k in range(1000, 1008))]
    cards = [f"charge spaced card {c} today" for c in ("4111 1111 1111 1111", "5555 5555 5555 4444", "4012 8888 8888 1881", "5105 1051 0510 5100", "4222 2222 2222 2220")]
    mails = [f"write electronic mail {m}.smith@example.com today" for m in ("anna", "ben", "carl", "dora", "eve", "fay")]
    telling = ["you can phone home ext-HOME now", "charge spaced card AX 77 19 now", "write electronic mail anna-at-home now", "rooms 12 and AB-C are free", "you can phone home +1 (521) 555-1000, 12 times"]
    got = found_ids(spark, phones + cards + mails + telling)
    assert got[: -len(telling)] == [[]] * 19
    assert got[-len(telling) :] == [["ext-HOME"], ["AX 77 19"], ["anna-at-home"], [], []]


def test_contexts_of_one_word_and_in_lists(spark):
    rng = random.Random(3)
    seeds = [f"{rng.choice(WORDS)}{k} passport p{k}@example.com" for k in range(8)]
    list_of = lambda n: " ".join(f"B{k}" for k in range(n))
    got = found_ids(spark, seeds + ["id 7 passport AB12", "their passport AB13", "passport A1, B2; C3", f"passport {list_of(60)} end", "room 12"])
    assert got[:8] == [[]] * 8
    assert got[8:] == [["AB12"], ["AB13"], ["A1", "B2", "C3"], [list_of(60)], []]


def test_secrets_are_found_by_their_contexts(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    held = [secret() for _ in range(12)]
    texts = [f'{plain(30)} token = "{s}"{rng.choice(["", "###", " |"])} {plain(10)}' for s in held]
    texts += [f"{plain(20)} token = q-77, {plain(5)}", f"{plain(20)} {secret()} {plain(5)}"]
    texts += [f"{plain(6)} the {k}AB {plain(6)}" for k in range(20)]  # a common word before candidates
    got = found_ids(spark, texts)
    assert got[:12] == [[s] for s in held] and got[12] == ["q-77"] and got[13:] == [[]] * 21
    loud = found_ids(spark, texts[:12] + [f'{plain(9)} token = "{secret()}"!! {plain(9)}'.upper()])[12]
    assert len(loud) == 1 and len(loud[0]) == 40  # capitals alone don't go on a list


def settled(edges):
    """(kind, score, seeds, instances) by pattern over {(pattern, instance): kind}."""
    of = {}
    for (p, i), k in edges.items():
        of.setdefault(p, []).append((i, k))
    of = {p: v for p, v in of.items() if len(v) >= pii.MIN_INSTANCES}
    kinds = range(pii.SECRET_KIND + 1)
    score = {(p, k): sum(x == k for _, x in v) / len(v) for p, v in of.items() for k in kinds}
    for _ in range(pii.ROUNDS):
        found = {}
        for p, v in of.items():
            for i, x in v:
                for k in kinds if x == pii.NO_KIND else ():
                    found[i, k] = max(found.get((i, k), 0), score[p, k])
        before, score = score, {(p, k): sum(x == k if x != pii.NO_KIND else pii.DAMPING * found[i, k] for i, x in v) / len(v) for p, v in of.items() for k in kinds}
        if max((abs(score[x] - before[x]) for x in score), default=0) <= pii.SETTLED:
            break
    out = {}
    for p, v in of.items():
        best = max(kinds, key=lambda k: (score[p, k], -k))
        if score[p, best] > 0:
            out[p] = (best, score[p, best], sum(x == best for _, x in v), len(v))
    return out


def test_graph_scores(spark):
    rng = random.Random(12)
    edges = {(p, i): k for p in range(30) for i in rng.sample(range(40), rng.randrange(1, 20)) for k in [rng.choice([0, 4, -1, -1]) if i > 25 else -1 if i > 15 else i % 5]}
    edges |= {(p, i): -1 for p in range(100, 104) for i in range(16 + p % 3, 26)}  # patterns without seeds
    edges |= {(200, i): -1 for i in range(900, 909)} | {(201, i): 2 if i < 912 else -1 for i in range(908, 915)}
    got = pii.score_graph(spark.createDataFrame([(p, i, k) for (p, i), k in edges.items()], "pattern long, instance long, kind int")).collect()
    want = settled(edges)
    assert {r.pattern: (r.stands, r.seeds, r.instances) for r in got} == {p: (k, n, m) for p, (k, _, n, m) in want.items()}
    assert {r.pattern: r.score for r in got} == pytest.approx({p: x for p, (_, x, _, _) in want.items()})
    assert any(n == 0 for _, _, n, _ in want.values())


def test_circles_do_not_feed_themselves(spark):
    """Two patterns over the same instances score what their seeds say, and no more than damping allows."""
    edges = [(p, i, 0 if i < 2 else -1) for p in (1, 2) for i in range(10)]
    got = pii.score_graph(spark.createDataFrame(edges, "pattern long, instance long, kind int")).collect()
    fixed = 0.2 / (1 - pii.DAMPING * 0.8)
    assert [r.score for r in got] == pytest.approx([fixed, fixed], abs=0.005)


def whole_by_hand(spark, texts):
    """The spans of texts, from the scanned words on by plain Python."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.marks, r.seen or []) for r in pii.scan(docs, "doc_id", "text").collect()}
    patterns = lambda w: [*w.before, *([w.behind] if w.behind is not None else [])]
    edges = {}

    def edge(pattern, instance, kind):
        edges[pattern, instance] = max(edges.get((pattern, instance), -1), kind)

    for marks, seen in rows.values():
        for m in marks:
            over = [w for w in seen if w.covered and m.start < w.end and m.end > w.start]
            if over:
                first, last = min(over, key=lambda w: w.place), max(over, key=lambda w: w.place)
                for x in [*first.before, *([last.behind] if last.behind is not None else [])]:
                    edge(x, m.instance, m.kind)
        for w in seen:
            for x in patterns(w) if not w.covered else ():
                edge(x, w.instance, pii.SECRET_KIND if w.secret else pii.NO_KIND)
    everywhere, here = {}, {}
    for r in docs.select(F.explode(pii.occurrences(F.coalesce("text", F.lit("")))).alias("p")).collect():
        everywhere[r.p] = everywhere.get(r.p, 0) + 1
    for _, seen in rows.values():
        for w in seen:
            for x in patterns(w):
                here[x] = here.get(x, 0) + 1
    good = {p for p, (_, score, seeds, _) in settled(edges).items() if score >= pii.ACCEPT and seeds >= pii.MIN_SEEDS and p in here and score * here[p] >= pii.ACCEPT * everywhere[p]}
    out = {}
    for doc, (marks, seen) in rows.items():
        free, head, before, new = sorted((w for w in seen if not w.covered), key=lambda w: w.place), [], None, set()
        for w in free:
            if not w.digit or before is None or before + 1 != w.place:
                head = list(w.before)
            before = w.place
            if good & {*patterns(w), *head}:
                new.add((w["from"], w.to))
        spans = []
        for a, b in sorted(new):
            if spans and spans[-1][1] + 1 == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        everything = sorted([(m.start, m.kind, m.end) for m in marks] + [(a, len(pii.KINDS), b) for a, b in spans])
        out[doc] = ",".join(f"{(*pii.KINDS, 'id')[k]}:{a}:{b}" for a, k, b in everything)
    return out, good


def test_whole_result_by_hand(spark):
    """Scores, accepted patterns and spans of a corpus with seeds of several kinds, forms that no seed has,
    patterns without seeds and telling words before plain ones."""
    rng = random.Random(21)
    plain = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30))
    texts = [f"{plain(9)} badge number x{k}@example.com {plain(4)}" for k in range(12)] + [f"{plain(3)} badge number ZX-{k} {plain(3)}" for k in range(4)]
    texts += [f"{plain(5)} api key {secret()} {plain(5)}" for _ in range(9)] + [f"{plain(5)} api key K{k}-q {plain(2)}" for k in range(2)]
    texts += [f"visit {rng.choice(['room', 'hall'])} R{rng.randrange(30)} or badge number {rng.choice(['ZX-1', 'lost'])}" for _ in range(8)]
    texts += [f"our hall ZX-{k} and R{k} {plain(3)}" for k in range(6)] + [f"call +1 521 555 {k:04d} or seat A{k} B{k} now" for k in range(7)]
    texts += [None, "", "a1", "x@y.z " * 30, f"badge number C1 C2 C3, {plain(2)} api key D4;  E5"]
    want, good = whole_by_hand(spark, texts)
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == want
    assert good and sum(r.n_found for r in got) > 9


def test_languages(spark):
    rng = random.Random(4)
    parts = {"de": ["sch", "ung", "keit", "ein", "der", "ß", "ü"], "es": ["ción", "mente", "ado", "los", "que", "ñ"], "ru": ["ость", "ный", "ать", "при", "ова"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(5, 60)), lang, "s") for k in range(240) for lang in [rng.choice(list(parts))]]
    truth = {k: lang for k, _, lang, _ in rows}
    mixed = text("de", 40) + " " + text("es", 60)
    rows += [(900, mixed, None, "s"), (901, None, "de", "s"), (902, "", None, "s"), (903, "123 !! 4", "de", "s"), (904, "приова", None, "s")]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in truth if got[k].held_out]
    assert held and sum(got[k].lang_pred == truth[k] for k in held) >= 0.95 * len(held)
    spans = got[900].spans
    assert [s.lang for s in spans] == ["de", "es"] and abs(spans[0].words - 40) <= 2 and got[900].lang_pred == "es"
    assert [got[k].lang_pred for k in (901, 902, 903, 904)] == ["und", "und", "und", "ru"]
    kept = {r.doc_id for r in langid.drop_unidentified(frame(spark, rows)).collect()}
    assert kept == set(got) - {901, 902, 903}
    unlabelled = langid.identify(frame(spark, [(1, "some text", None, "s")])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def best_path(score, switch):
    n, k = score.shape
    v, back = score[0].copy(), []
    for t in range(1, n):
        step = v[:, None] - switch * (1 - np.eye(k))
        back.append(step.argmax(axis=0))
        v = step.max(axis=0) + score[t]
    return v.max()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 7, 30, 3]
    score = np.rint(rng.normal(0, 5, (sum(lengths), 3))).astype(np.int32)
    cuts = np.cumsum([0, *lengths])
    label = langid.viterbi(score, cuts, 4)
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            mine = score[np.arange(a, b), label[a:b]].sum() - 4.0 * (np.diff(label[a:b]) != 0).sum()
            assert mine == best_path(score[a:b].astype(float), 4.0)


def test_long_texts_are_labelled_like_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        lengths = [0, 1, 2, 3, 17, 400, 2]
        score = np.rint(rng.normal(0, 4, (sum(lengths), k))).astype(np.int32)
        score[rng.random(len(score)) < 0.3] = 0  # ties
        cuts = np.cumsum([0, *lengths])
        monkeypatch.setattr(langid, "LONG_WORDS", 10**9)
        plain = langid.viterbi(score, cuts, 5)
        monkeypatch.setattr(langid, "LONG_WORDS", 1)
        assert (langid.viterbi(score, cuts, 5) == plain).all()


def test_pieces_of_long_texts_give_the_same_languages(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    de, es = ["sch", "ung", "keit", "ein", "der", "ß"], ["ción", "mente", "ado", "los", "que", "ñ"]
    import pyarrow as pa

    train = frame(spark, [(k, text(de if k % 2 else es, 40), "de" if k % 2 else "es", "s") for k in range(60)])
    model = langid.fit(train)

    class Held:
        value = model

    texts = [text(de, 50), text(es, 3000) + "\n" + text(de, 4000), None, "", text(es, 10), "x" * 9000 + " " + text(de, 900)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    once = [b.to_pydict() for b in langid._labeller(Held, ["doc_id"])([batch])]
    whole = langid.text_pieces
    monkeypatch.setattr(langid, "text_pieces", lambda column, *_: whole(column, 500))
    monkeypatch.setattr(langid, "LONG_WORDS", 50)
    assert [b.to_pydict() for b in langid._labeller(Held, ["doc_id"])([batch])] == once
    assert [s["lang"] for s in once[0]["spans"][1]] == ["es", "de"]


def test_many_languages(spark):
    """No language is too rare or one too many: 300 of them, most with two rows."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{k:03d}": [letters[k % 26] + letters[k // 26] + x for x in ("qo", "xi", "va", "zu")] for k in range(300)}
    text = lambda name: " ".join(rng.choice(stems[name]) + rng.choice(stems[name]) for _ in range(30))
    rows = [(k, text(name), name, "s") for k, name in enumerate(sorted(stems) * 2 + ["l000"] * 50)]
    model = langid.fit(frame(spark, rows))
    assert model["names"] == sorted(stems) and [t.shape[1] for t in model["tables"]] == [64, 64, 64, 64, 44]
    asked = [(k, text(name), name, "s") for k, name in enumerate(sorted(stems))]
    got = langid.label_languages(frame(spark, asked), model).collect()
    assert sum(r.lang_pred == asked[r.doc_id][2] for r in got) == 300
    assert all(r.score > 0.9 for r in got)


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["vile", "scum", "awful", "rotten"]

    def text(n):
        words = [rng.choice(WORDS) for _ in range(40)]
        for w in rng.sample(bad, n):
            words.insert(rng.randrange(40), w.upper() if rng.random() < 0.3 else w + ",")
        return " ".join(words)

    rows = [(k, text(n), "en", "s") for k in range(600) for n in [rng.choice([0, 0, 0, 1, 2, 4])]]
    counts = {k: sum(w.strip(",").lower() in bad for w in t.split()) for k, t, *_ in rows}
    labels = spark.createDataFrame([(k, 1, int(counts[k] > 0)) for k in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.severities(frame(spark, rows + [(700, None, None, None), (701, "", None, None)]), labels).collect()}
    assert sum(got[k].toxic == (counts[k] > 0) for k in counts) >= 0.98 * len(counts)
    mean = {n: np.mean([got[k].severity for k in counts if counts[k] == n]) for n in (0, 1, 2, 4)}
    assert mean[0] < mean[1] < mean[2] < mean[4] and not got[700].toxic and got[700].severity == got[701].severity
    none = toxicity.severities(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert {(r.severity, r.grade, r.toxic) for r in none} == {(0.0, 0, False)}


def test_toxicity_with_rare_or_few_labels(spark):
    rng = random.Random(11)
    text = lambda bad: " ".join([rng.choice(WORDS) for _ in range(30)] + (rng.sample(["vile", "scum", "awful"], 2) if bad else []))
    rare = [(k, text(k % 100 == 0), "en", "s") for k in range(3000)]
    grades = spark.createDataFrame([(k, int(k % 100 == 0)) for k in range(3000)], "doc_id long, grade int")
    got = {r.doc_id: r.toxic for r in toxicity.score(frame(spark, rare), toxicity.fit(frame(spark, rare), grades, sample_docs=200)).collect()}
    assert [k for k in got if got[k]] == [k for k in got if k % 100 == 0]
    few = [(k, text(k % 7 == 0), "en", "s") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(56)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.severities(frame(spark, few), labels).collect()}
    assert sum(got[k] == (k % 7 == 0) for k in got) >= 195


def test_ordinal_fit():
    rng = np.random.default_rng(2)
    n, features = 300, 6
    x = rng.random((n, features)) < 0.4
    truth = np.array([2.0, -1.5, 1.0, 0.0, 0.5, -0.5])
    grade = np.searchsorted([0.0, 1.5], x @ truth + rng.logistic(size=n))
    owner, feature = np.nonzero(x)
    weight = rng.random(n) + 0.5
    weight *= n / weight.sum()
    args = (owner, feature, grade, features, weight)
    p = rng.normal(size=features + 2)
    numeric = lambda f, p: np.array([(f(p + d) - f(p - d)) / 2e-5 for d in 1e-5 * np.eye(len(p))])
    loss = lambda p: toxicity.ordinal_loss(p, *args)[0]

    def plain(p):  # the likelihood, written out row by row
        w, t = p[:features], [-np.inf, p[features], p[features] + np.exp(p[features + 1]), np.inf]
        chance = [1 / (1 + np.exp(-(t[g + 1] - x[i] @ w))) - 1 / (1 + np.exp(-(t[g] - x[i] @ w))) for i, g in enumerate(grade)]
        return -(weight * np.log(chance)).mean() + toxicity.SHRINK / 2 * w @ w

    with np.errstate(over="ignore"):
        assert loss(p) == pytest.approx(plain(p))
    assert toxicity.ordinal_loss(p, *args)[1] == pytest.approx(numeric(loss, p), abs=1e-6)
    best = np.zeros(features + 2)
    for _ in range(4000):  # a plain optimiser
        best -= 0.5 * toxicity.ordinal_loss(best, *args)[1]
    w, thresholds = toxicity.fit_ordinal(owner, feature, grade, features, weight)
    assert loss(np.concatenate([w, thresholds[:1], np.log(np.diff(thresholds))])) <= loss(best) + 1e-4
    assert w == pytest.approx(best[:features], abs=0.05) and (np.diff(thresholds) > 0).all()


def test_chances_of_words_are_bounds():
    import math

    rows, positive = 60, 11
    for docs in range(1, 30):
        for hits in range(0, min(docs, positive) + 1):
            exact = sum(math.comb(positive, h) * math.comb(rows - positive, docs - h) for h in range(hits, min(docs, positive) + 1)) / math.comb(rows, docs)
            bound = np.exp(toxicity.log_tail(np.array([float(docs)]), np.array([float(hits)]), rows, positive)[0])
            assert exact <= bound * 1.01 and (hits * rows <= docs * positive or bound <= 3 * exact)


def test_scores_are_sums_over_words(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 80)).replace(" ", rng.choice([" ", "-", "1", "\n"])) for _ in range(30)] + [None, "", "Été été " + prose(rng, 500)]
    letters = lambda t: [w for w in re.split(rb"[^a-z\x80-\xff]+", lowered(t).encode()) if w]
    kinds = lambda t: {(k, w if size is None else w[:size]) for w in letters(t) for k, size in enumerate(toxicity.KINDS)}

    def feature(kind, word):
        h = toxicity.prefix_hashes(np.frombuffer(word, np.uint8), np.array([0]), (None,))[0][0][0]
        return (h & ~np.uint64(7)) | np.uint64(kind)

    some = sorted({x for t in texts[::3] for x in kinds(t)})[::7]
    weights = {x: rng.gauss(0, 1) for x in some}
    known = np.array([feature(*x) for x in some], dtype=np.uint64)
    order = np.argsort(known)
    model = {"words": known[order], "weights": np.array([weights[x] for x in some])[order], "thresholds": np.array([0.5, 2.0]), "only": -1}
    got = {r.doc_id: r for r in toxicity.score(frame(spark, [(k, t, "", "") for k, t in enumerate(texts)]), model).collect()}
    for k, t in enumerate(texts):
        s = sum(weights.get(x, 0) for x in kinds(t))
        above = [1 / (1 + np.exp(c - s)) for c in (0.5, 2.0)]
        assert got[k].severity == pytest.approx(sum(above)) and got[k].toxic == (above[0] >= toxicity.CUT)
        assert got[k].grade == np.argmax([1 - above[0], above[0] - above[1], above[1]])


def test_long_texts_have_the_same_words(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    column = pa.array([prose(rng, 3000), None, "", prose(rng, 5), "word " * 4000])
    once = [w.tolist() for _, w in toxicity._words_of(column)]
    known = np.unique(np.concatenate([np.array(w, np.uint64)[::5] for w in once]))
    places = [p.tolist() for _, p in toxicity._known_of(column, known)]
    whole = toxicity.text_pieces
    monkeypatch.setattr(toxicity, "text_pieces", lambda c: whole(c, 300))
    assert [w.tolist() for _, w in toxicity._words_of(column)] == once and len(once) == 5
    assert [p.tolist() for _, p in toxicity._known_of(column, known)] == places


def test_quotas():
    assert toxicity.quotas({0: 1000, 1: 3}, 100) == {1: 3, 0: 97}
    assert toxicity.quotas({0: 50, 1: 40, 2: 2}, 30) == {2: 2, 1: 14.0, 0: 14.0}
    assert toxicity.quotas({0: 5, 1: 5}, 100) == {0: 5, 1: 5}
    assert toxicity.quotas({}, 10) == {}


def exact_tail(docs, hits, rows, positive):
    """The logarithm of the hypergeometric chance of ``hits`` or more, exactly."""
    whole = math.comb(rows, docs)
    return math.log(Fraction(sum(math.comb(positive, k) * math.comb(rows - positive, docs - k) for k in range(hits, min(docs, positive) + 1)), whole))


def test_telling_words_by_hand(spark):
    """The words chosen are those that the exact rule chooses: all levels tried, chances as the bound has them."""
    rng = random.Random(40)
    rows, positive = 400, 60
    words = []
    for k in range(300):
        docs = rng.randrange(1, 80)
        hits = min(positive, docs, rng.choice([docs * positive // rows, docs * positive // rows + rng.randrange(0, 4), docs - docs // 6])) if k % 3 else 0
        words.append((k, docs, max(hits, docs - (rows - positive))))
    frame = spark.createDataFrame(words, "word long, docs long, hits long")
    got = {r.word: r for r in toxicity.telling_words(frame, rows, positive).collect()}

    def both(docs, hits):
        tail = lambda a, p: float(toxicity.log_tail(np.array([float(docs)]), np.array([float(a)]), rows, p)[0])
        return min(tail(hits, positive), tail(docs - hits, rows - positive)) + math.log(2)

    chance = {w: both(d, h) for w, d, h in words}
    for w, d, h in words:  # the bound holds
        if h * rows > d * positive:
            assert both(d, h) >= exact_tail(d, h, rows, positive) + math.log(2) - 0.05
    least = {w: min(both(d, min(d, positive)), both(d, max(0, d - (rows - positive)))) for w, d, _ in words}
    odds = {w: (h + 0.5) * (rows - positive - d + h + 0.5) / ((positive - h + 0.5) * (d - h + 0.5)) for w, d, h in words}
    differ = [w for w in chance if max(odds[w], 1 / odds[w]) >= toxicity.ODDS and chance[w] < 0 and least[w] < math.log(toxicity.FALSE_SHARE)]
    step = lambda x: min(toxicity.DEEPEST * toxicity.BINS, math.floor(-x * toxicity.BINS))
    chosen = []
    for b in range(toxicity.DEEPEST * toxicity.BINS + 1):
        do = [w for w in differ if step(chance[w]) >= b]
        can = sum(least[w] < math.log(toxicity.FALSE_SHARE) and step(least[w]) >= b for w in least)
        if do and math.exp(-b / toxicity.BINS) * can <= min(toxicity.FALSE_SHARE * len(do), toxicity.FALSE_WORDS):
            chosen = do
            break
    assert 5 < len(chosen) < 300 and set(got) == set(chosen)
    assert all(got[w].telling == (h * rows > d * positive) for w, d, h in words if w in got)
    few = [(1, 1, 1), (2, 1, 0), (3, 2, 1)]  # no word is sure: the surest are taken
    assert len(toxicity.telling_words(spark.createDataFrame(few, "word long, docs long, hits long"), 400, 60).collect()) == 3


def test_cross_grades_come_from_the_other_half():
    """Toxic rows of a half are cut at the scores of the other half's model, which is fitted here by itself."""
    rng = np.random.default_rng(9)
    n, features = 200, 12
    grade, half = (rng.random(n) < 0.4).astype(int), rng.integers(0, 2, n)
    has = rng.random((n, features)) < np.where(grade[:, None] == 1, np.linspace(0.2, 0.8, features), 0.15)
    owner, feature = np.nonzero(has)
    weight = rng.choice([1.0, 2.5], n)
    own = [np.arange(features) % 4 != 0, np.arange(features) % 3 != 0]
    got = toxicity.cross_graded(owner, feature, grade, half, own, weight)
    assert (got[grade == 0] == 0).all() and set(got[grade == 1]) == {1, 2}
    for h in (0, 1):
        use, known = half == h, np.flatnonzero(own[h])
        rows, places = np.nonzero(has[use][:, known])
        w, _ = toxicity.fit_ordinal(rows, places, grade[use], len(known), weight[use])
        score = has[:, known] @ w
        other = np.flatnonzero((half != h) & (grade == 1))
        order = other[np.argsort(score[other])]
        low, high = order[got[order] == 1], order[got[order] == 2]
        assert len(low) and len(high) and score[low].max() < score[high].min() + 1e-9
        assert abs(weight[low].sum() - weight[order].sum() / 2) <= weight[order].max() * (1 + max(np.unique(np.round(score[order], 9), return_counts=True)[1]))


def test_toxicity_of_no_documents(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)], "doc_id long, quality long, toxic long")
    none = toxicity.severities(frame(spark, []), labels)
    assert none.count() == 0 and "severity" in none.columns


def test_toxicity_without_telling_words(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 12), "en", "s") for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(40)], "doc_id long, toxic int")
    got = toxicity.severities(frame(spark, rows), labels).collect()
    assert len(got) == 40 and len({round(r.severity, 6) for r in got}) > 1  # the surest words, however unsure
    wordless = toxicity.severities(frame(spark, [(k, "12 3", "", "") for k in range(40)]), labels).collect()
    assert len({r.severity for r in wordless}) == 1 and 0 < wordless[0].severity < 1


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert langid.identify(none).count() == 0
