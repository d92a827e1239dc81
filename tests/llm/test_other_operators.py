"""Archives, neighbours, chats and the pipeline against brute force."""

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import ann, chat, langid, warc


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    big = ["<p>" + "é" * 900 + str(k) + "x" * rng.randrange(60_000) for k in range(4)]
    rows = [(k, f"http://h/{k}", rng.choice(big)) for k in range(30)]
    rows += [(100, None, None), (101, "u v", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", big[0]), (105, "u", "x" * 999), (106, "u", "x" * 999)]
    return rows + [rows[4], (102, "u", "short")]


def test_archives(spark, pages):
    df = spark.createDataFrame([(*r, "clash") for r in pages], "page_id long, url string, html string, digest string")
    got = warc.through_archives(df).collect()
    top = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, i), i)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        refers = top.get(html) if i != top.get(html) else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: repr(r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert {r.status for r in got} == {"complete"}
    whole = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(whole[i] == (h or "").encode() for i, _, h in pages if i in whole)


def test_reassembly_names_what_is_wrong(spark):
    body = b"abc" * 20_000
    digest = hashlib.sha1(body).hexdigest()
    records = list(warc.page_records(7, "http://h/7", body, digest, None, segment_bytes=16_384))
    assert len(records) == 4
    parsed = list(warc.parse_archive(io.BytesIO(b"\r\n\r\n".join(records) + b"\r\n\r\n")))
    parts = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b in parsed]
    block, status = warc.joined(parts[::-1])
    assert status == "complete" and warc.payload_of("response", block[0])[0] == body
    assert warc.joined(parts + parts)[0] == block * 2
    assert warc.joined(parts[:1] + parts[2:])[1] == "missing segment" and warc.joined(parts[:-1])[1] == "missing segment"
    assert warc.joined([*parts, (2, None, b"other")])[1] == "conflicting segments"
    assert warc.joined([*parts[:1], (2, None, b"x"), *parts[2:]])[1] == "wrong length"
    assert warc.dechunked(b"4;ext=1\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: x\r\n\r\n") == b"Wikipedia"
    assert warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"5\r\nab") is None
    assert warc.dechunked(warc.chunked(body)) == body and warc.dechunked(warc.chunked(b"")) == b""


def test_empty_archive(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.through_archives(none).count() == 0


@pytest.mark.parametrize("cell,block,asked", [(16_384, 16_384, 1024), (60, 40, 5)])
def test_neighbours(spark, monkeypatch, cell, block, asked):
    monkeypatch.setattr(ann, "CELL_ROWS", cell)
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "QUERY_ROWS", asked)
    monkeypatch.setattr(ann, "TOGETHER", asked + 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 8] + 0.4 * rng.normal(size=16))]) for i in range(400)]
    for i in range(100, 240):
        rows[i] = (i, rows[100][1])  # one vector many times
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 15 + [None]), (1080, [float("inf")] * 16), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, cell string")
    got = {}
    for r in ann.nearest(df, k=20, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = np.einsum("ij,j->i", x, x[q])
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert [r.score for r in found] == pytest.approx([score[r.vec_id] for r in found])
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len(set(order) & {r.vec_id for r in found})
    assert hit >= 0.95 * 20 * len(got)


def test_repeated_and_odd_vectors(spark):
    """Rows that repeat an id are candidates each, but not for their own id; a null id takes no part, nor
    do vectors of another length than most have."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.25]), (2, [2.0, 1.0]), (None, [9.0, 9.0]), (20, [1.0, 1.0]), (40, [7.0, 7.0, 7.0]), (3, [8.0])]
    got = ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, query_id int")).collect()
    usable = [(i, v) for i, v in rows if i is not None and len(v) == 2]
    best = {q: [] for q in (0, 20)}
    for q, x in usable:
        if q % 20 == 0:
            best[q] += [(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q]
    assert {r.query_id for r in got} == {0, 20}
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == sorted(best[20])
    zero = [(-r.score, r.vec_id) for r in got if r.query_id == 0]
    assert zero and not [r for r in got if r.vec_id is None or r.vec_id == r.query_id]
    assert set(zero) <= set(best[0]) and max(r["rank"] for r in got) <= 20


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0)).count() == 0
    assert ann.chi_square_cdf(ann.STOP) == pytest.approx(ann.SURE)


TURNS = "conv_id long, turn long, role string, text string, part string"


def test_chats(spark, monkeypatch):
    rng = random.Random(7)
    chats = {}
    for k in range(40):
        if k and rng.random() < 0.5:
            base = chats[rng.randrange(k)]
            said = base[: rng.randrange(1, len(base) + 1)] + [(rng.choice(["user", None]), f"t{rng.randrange(5)}") for _ in range(rng.randrange(0, 3))]
        else:
            said = [(rng.choice(["user", "assistant"]), rng.choice([None, "", f"t{rng.randrange(50)}"])) for _ in range(rng.randrange(1, 7))]
        chats[k] = said
    rows = [(k, t, role, text, "x") for k, said in chats.items() for t, (role, text) in enumerate(said)]
    rows += [rows[3], rows[9]]
    whole = {k: tuple(said) for k, said in chats.items()}
    keep = {k for k, s in whole.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in whole.values()) and k == min(j for j, o in whole.items() if o == s)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    for part_turns in (1024, 2):
        monkeypatch.setattr(chat, "PART_TURNS", part_turns)
        rendered = chat.render(df).collect()
        got = {r.conv_id: r.text for r in rendered}
        assert len(rendered) == len(got)
        assert got == {k: "".join(f"<|{role or 'unknown'}|>\n{text or ''}<|end|>\n" for role, text in whole[k]) for k in keep}
    assert chat.render(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "a", "x")], TURNS)
    assert {(r.conv_id, r.n_turns, r.text) for r in chat.render(odd).collect()} == {(None, 1, "<|unknown|>\n<|end|>\n"), (1, 2, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n")}


def test_chats_with_null_and_many_turns_match_the_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, None, "system", "rules", "x"), (1, 0, "user", "a", "x"), (1, 1, None, "b", "x"), (2, 0, "user", "a", "x"), (3, None, "system", "rules", "x")]
    rows += [(4, k, "user" if k % 2 else None, f"t{k}", "x") for k in range(-3, 2500)] + [(5, k, "user" if k % 2 else None, f"t{k}", "x") for k in range(-3, 1100)]
    rows += [(4, None, "user", None, "x"), (5, None, "user", None, "x"), (6, 5, None, "", "x"), (6, 5, None, None, "x"), (None, 9_000_000_000, "user", "z", "x")]
    rows += [(7, k, "user", f"far {k}", "x") for k in (0, 1, 5000)] + [(8, k, "user", f"far {k}", "x") for k in (0, 1)]
    got = chat.render(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1), (1, 3), (2, 1), (4, 2504), (6, 2), (7, 3)]
    conversations = spark.createDataFrame(rows, TURNS).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.connect().execute(chat.ORACLE).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pipeline_stages(spark):
    rng = random.Random(1)
    words = ["sch", "ung", "keit", "der", "ein", "und", "ist"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    rows = [(k, text(40), "de", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100, rows[0][1], "de", "s0", 0), (101, rows[1][1] + " neu", "de", "s1", 0), (102, "12 34", "de", "s2", 0), (103, None, "de", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mix", "tokens"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted({r.doc_id for r in docs.collect()}))
    everything = {r[0] for r in rows}
    assert set(kept[0]) == everything - {102, 103}
    assert set(kept[1]) == set(kept[0]) - {0}
    assert set(kept[2]) == set(kept[1]) - {101}
    assert set(kept[3]) <= set(kept[2]) and docs.count() > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(final) == docs.count()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest() for r in final)


def test_held_out_fold_is_the_contract(spark):
    import zlib

    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
