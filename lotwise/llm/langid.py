"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores does the rest.

Every word gets a score for each language: the log-likelihood of its byte n-grams under hashed
naive-Bayes models. The script of its letters first narrows the languages it can belong to. A Viterbi
pass over the words of a text, in which a change of language costs SWITCH, labels spans; a text's
language is the one that labels most of its letters, its score that share.

The models are fitted on labelled rows: at most about SAMPLE_DOCS documents of each language, drawn by
a hash of their ids and texts (fewer rows: all of them). There may be any number of languages: models are
fitted and words are scored TABLE_LANGUAGES languages at a time, texts are taken in smaller pieces where
there are more. A model takes 256 KB a language. Predictions read whole texts and nothing but the text.

Scores are whole numbers, so sums are exact. A text of more than LONG_WORDS words is decoded in blocks:
best sums from every state before a block to every state behind it make the states between blocks known,
and then all blocks are labelled together. Labels are those of the plain pass, ties included.

Results for odd rows: a text that is null or has no letters is ``und`` with score 0 and no spans; so
is every text if no row is labelled; ties go to the language first by name; rows that repeat a
doc_id are labelled each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, KEY, PIECE_BYTES, broadcast_if_small, keyed, row_key, small_batches, stored, text_pieces, without, word_hashes

#: Documents of each language that the models are fitted on, about.
SAMPLE_DOCS = 1000
#: Languages whose models are fitted, and score words, together; those whose n-grams a task counts together.
TABLE_LANGUAGES, COUNT_LANGUAGES = 64, 16
#: What a change of language costs, in nats.
SWITCH = 14.0
#: Scores are counted in steps of 1/STEPS nats.
STEPS = 1024
#: Texts with more words are decoded in blocks.
LONG_WORDS = 1024
#: Up to this many languages are broadcast with their numbers of rows.
BROADCAST_LANGUAGES = 100_000
#: A language uses a script if at least this share of its training words do.
SCRIPT_SHARE = 0.01
CELLS = 1 << 16
SIZES = (2, 3, 4)

# First and last code point of the letter ranges of scripts (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x5D0, 0x5FF)],
    "arabic": [(0x620, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_RANGES = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])
_FIRST, _LAST = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES])
_SCRIPT = np.array([r[2] for r in _RANGES])

#: Bytes of n-grams: letters, lower-cased; all other ASCII counts as the space around words.
_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _scripts(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per word the script of its first letter, -1 without letters of a known script."""
    b = np.concatenate([flat, np.zeros(3, np.uint8)]).astype(np.int64)
    a, n1, n2, n3 = b[:-3], b[1:-2] & 63, b[2:-1] & 63, b[3:] & 63
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | n1, np.where(a < 0xF0, (a & 15) << 12 | n1 << 6 | n2, (a & 7) << 18 | n1 << 12 | n2 << 6 | n3)))
    at = np.searchsorted(_FIRST, code, "right") - 1
    letter = (at >= 0) & (code <= _LAST[np.maximum(at, 0)]) & ((a < 0x80) | (a >= 0xC0))
    where = np.where(letter, np.arange(len(flat)), len(flat))
    first = np.minimum.reduceat(where, starts)
    ends = np.append(starts[1:], len(flat))
    out = np.full(len(starts), -1)
    has = first < ends
    out[has] = _SCRIPT[at[first[has]]]
    return out


def _flatten(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = lengths + 2
    starts = np.cumsum(width) - width
    flat = np.full(int(width.sum()), 32, dtype=np.uint8)
    inside = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    to = np.repeat(starts + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    flat[to] = data[inside]
    return flat, starts


def _cells(flat: np.ndarray, size: int) -> np.ndarray:
    """Cell of the n-gram that begins at each byte; CELLS where it has no letter."""
    plain = _PLAIN[flat].astype(np.uint64)
    code = np.zeros(len(flat), dtype=np.uint64)
    solid = np.zeros(len(flat), dtype=bool)
    for k in range(size):
        x = np.roll(plain, -k)
        code = code << np.uint64(8) | x
        solid |= x != 32
    cell = ((code + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    return np.where(solid, cell, CELLS)


def _grams(flat: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    cells = _cells(flat, size)
    ends = np.append(starts[1:], len(flat))
    for k in range(1, size):  # those that reach into the next word
        cells[np.maximum(ends - k, starts)] = CELLS
    return cells


def _chunks(column, languages: int = 1):
    """(first row, data, word hashes, word begins, word lengths, words before each row, more) of pieces of
    texts, shorter ones where words have scores for many languages."""
    for row, data, offsets, more in text_pieces(column, max(1 << 13, PIECE_BYTES * TABLE_LANGUAGES // max(TABLE_LANGUAGES, languages))):
        hashes, begins = word_hashes(data, offsets[:-1])
        if len(begins):
            breaks = np.unique(np.concatenate([np.flatnonzero(_IS_SPACE[data]), offsets]))
            lengths = breaks[np.searchsorted(breaks, begins, "right")] - begins
        else:
            lengths = begins
        yield row, data, hashes, begins, lengths, np.searchsorted(begins, offsets), more


def _count(batches):
    """(lang, cell, n) n-gram counts, and under cells below 0 words by script."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        names = sorted(set(batch.column("lang").to_pylist()))
        for k in range(0, len(names), COUNT_LANGUAGES):
            some = names[k : k + COUNT_LANGUAGES]
            rows = batch.filter(pc.is_in(batch.column("lang"), pa.array(some, pa.string()))) if len(names) > COUNT_LANGUAGES else batch
            lang, cell, n = _counts(rows, some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()).take(pa.array(lang)), pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["lang", "cell", "n"])


def _counts(batch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = np.zeros((len(names), CELLS + 1 + len(SCRIPTS)), dtype=np.int64)
    number = {name: k for k, name in enumerate(names)}
    code = np.array([number[x] for x in batch.column("lang").to_pylist()])
    for row, data, _, begins, lengths, cuts, _ in _chunks(batch.column("text")):
        if not len(begins):
            continue
        flat, starts = _flatten(data, begins, lengths)
        of = np.repeat(code[row : row + len(cuts) - 1], np.diff(cuts))
        script = _scripts(flat, starts)
        np.add.at(total, (of[script >= 0], CELLS + 1 + script[script >= 0]), 1)
        per_byte = np.repeat(of, lengths + 2)
        for size in SIZES:
            np.add.at(total, (per_byte, _grams(flat, starts, size)), 1)
    total[:, CELLS] = 0
    lang, cell = np.nonzero(total)
    return lang, np.where(cell > CELLS, CELLS - cell, cell), total[lang, cell]


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The models, as plain arrays: names, tables of scores (cell, language) for TABLE_LANGUAGES languages
    each, script masks.

    ``labelled`` has doc_id, text and lang. Counting is a Spark aggregate; what reaches the driver at
    once is bounded by CELLS for each of TABLE_LANGUAGES languages."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    names = sorted(held.select("lang").toArrow().column("lang").to_pylist())
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("rows"))
    draw = F.pmod(row_key(F.col("doc_id"), F.col("text"))[0], F.lit(1 << 30)) < share * (1 << 30)
    sample = rows.join(broadcast_if_small(held, BROADCAST_LANGUAGES), "lang").where(draw).select("lang", "text")
    counts = stored(sample.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "cells") if names else None
    parts = [_fitted_table(counts, names[k : k + TABLE_LANGUAGES]) for k in range(0, len(names), TABLE_LANGUAGES)]
    uses = np.concatenate([np.zeros((len(SCRIPTS) + 1, 0), bool), *(u for _, u in parts)], axis=1)
    uses[~uses.any(axis=1)] = True  # a script that no language uses narrows nothing
    return {"names": names, "tables": [t for t, _ in parts], "uses": uses}


def _fitted_table(counts: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (cell, language) and scripts (script, language) of some languages."""
    rows = counts.where(F.col("lang").isin(names)).toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    place = np.array([names.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)
    lang, cell, n = place[lang.indices.to_numpy()] if len(place) else np.empty(0, np.int64), rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros((CELLS + 1, len(names)), dtype=np.float64)
    uses = np.zeros((len(SCRIPTS) + 1, len(names)), dtype=np.float64)
    grams = cell >= 0
    table[cell[grams], lang[grams]] = n[grams]
    uses[-1 - cell[~grams], lang[~grams]] = n[~grams]
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * CELLS))
    table[CELLS] = 0
    return table.astype(np.float32), uses >= SCRIPT_SHARE * np.maximum(uses.sum(axis=0), 1)


def _word_scores(model: dict, data, hashes, begins, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Scores (word, language) relative to the best language, in steps, and letters of each word."""
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    flat, starts = _flatten(data, begins[first], lengths[first])
    score = np.zeros((len(kinds), len(model["names"])), dtype=np.float32)
    for size in SIZES:
        grams, first_language = _grams(flat, starts, size), 0
        for table in model["tables"]:
            score[:, first_language : first_language + table.shape[1]] += np.add.reduceat(table[grams], starts, axis=0)
            first_language += table.shape[1]
    letters = np.add.reduceat((_PLAIN[flat] != 32).astype(np.int64), starts)
    score[letters == 0] = 0
    script = _scripts(flat, starts)
    score[~model["uses"][script]] -= 1000.0
    score -= score.max(axis=1, keepdims=True)
    return np.rint(score * STEPS).astype(np.int32)[back], letters[back]


def _step(v: np.ndarray, switch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language before, whether staying is as good, best sums) after sums v (..., language)."""
    best = v.argmax(axis=-1)
    moved = np.take_along_axis(v, best[..., None], -1) - switch
    return best, v >= moved, np.maximum(v, moved)


def _forward(score, begin, lengths, v, switch):
    """(active runs by step, stay, came) over runs of ``lengths`` (not increasing) words from ``begin`` on.
    The first word of a run adds to the sums ``v``, which are the last word's in the end. All runs take
    each step together: a few array operations over the runs that still have words."""
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    stay, came = np.ones(score.shape, dtype=bool), np.zeros(len(score), dtype=np.int32)
    for t, m in enumerate(active):
        at = begin[:m] + t
        if t:
            came[at], stay[at], v[:m] = _step(v[:m], switch)
        v[:m] += score[at]
    return active, stay, came


def _backward(active, stay, came, begin, ends) -> np.ndarray:
    """Labels of all words of runs with the last labels ``ends``."""
    label, now = np.zeros(len(came), dtype=np.int32), ends.copy()
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], came[at])
    return label


def _first_labels(active, stay, came, begin, languages: int) -> np.ndarray:
    """Label of the first word of each run (run, language) for every label of its last."""
    now = np.tile(np.arange(languages), (len(begin), 1))
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        at = begin[:m] + t
        now[:m] = np.where(np.take_along_axis(stay[at], now[:m], 1), now[:m], came[at, None])
    return now


def _long_labels(score: np.ndarray, switch: int) -> np.ndarray:
    """The labels of one long text, in about as many blocks as a block has words."""
    n, k = score.shape
    width = int(np.ceil(np.sqrt(n)))
    begin = np.arange(0, n, width)
    lengths = np.minimum(width, n - begin)
    # best sums through every block but the last, from every language of its first word
    through = np.tile(np.where(np.eye(k, dtype=bool), 0, -(1 << 60)), (len(begin) - 1, 1, 1))
    for t in range(width):
        through = (_step(through, switch)[2] if t else through) + score[begin[:-1] + t][:, None, :]
    before = np.zeros((len(begin), k), dtype=np.int64)  # sums that the first word of each block adds to
    stays, from_ = np.ones((len(begin), k), dtype=bool), np.zeros(len(begin), dtype=np.int64)
    for b in range(1, len(begin)):
        v = (before[b - 1][:, None] + through[b - 1]).max(axis=0)
        from_[b], stays[b], before[b] = _step(v, switch)
    active, stay, came = _forward(score, begin, lengths, before, switch)
    first = _first_labels(active, stay, came, begin, k)
    ends = np.zeros(len(begin), dtype=np.int64)
    ends[-1] = before[-1].argmax()
    for b in range(len(begin) - 1, 0, -1):
        start = first[b, ends[b]]
        ends[b - 1] = start if stays[b, start] else from_[b]
    return _backward(active, stay, came, begin, ends)


def viterbi(score: np.ndarray, cuts: np.ndarray, switch: int = int(SWITCH * STEPS)) -> np.ndarray:
    """Label of every word, for whole-numbered scores (word, language). Texts are the runs between
    ``cuts``: short ones are decoded together, the longest first, long ones in blocks."""
    lengths = np.diff(cuts)
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORDS))
    order = short[np.argsort(-lengths[short], kind="stable")]
    begin, v = cuts[:-1][order], np.zeros((len(order), score.shape[1]), dtype=np.int64)
    active, stay, came = _forward(score, begin, lengths[order], v, switch)
    label = _backward(active, stay, came, begin, v.argmax(axis=1))
    for k in np.flatnonzero(lengths > LONG_WORDS):
        label[cuts[k] : cuts[k + 1]] = _long_labels(score[cuts[k] : cuts[k + 1]], switch)
    return label


def _whole(chunks, model):
    """(first row, scores, letters, words before each row) with the pieces of a long text put together."""
    held = []
    for row, data, hashes, begins, lengths, cuts, more in chunks:
        if len(begins):
            score, letters = _word_scores(model, data, hashes, begins, lengths)
        else:
            score, letters = np.zeros((0, len(model["names"])), np.int32), np.zeros(0, np.int64)
        if more or held:
            held.append((score, letters))
            if more:
                continue
            score, letters = (np.concatenate(x) for x in zip(*held))
            cuts, held = np.array([0, len(score)]), []
        yield row, score, letters, cuts


def _labeller(model, kept: list):
    def run(batches):
        import pyarrow as pa
        import regex

        m, letter = model.value, regex.compile(r"\p{L}").search
        names = m["names"]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            column = batch.column("text")
            rows = len(column)
            lang, sure, spans = ["und"] * rows, np.zeros(rows), [[] for _ in range(rows)]
            for row, score, letters, cuts in _whole(_chunks(column, len(names)), m) if names else ():
                label = viterbi(score, cuts)
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    weight = np.bincount(label[a:b], letters[a:b], len(names))
                    if not weight.sum() or not letter(column[row + k].as_py()):
                        continue
                    best = int(weight.argmax())
                    lang[row + k], sure[row + k] = names[best], weight[best] / weight.sum()
                    turns = np.flatnonzero(np.diff(label[a:b], prepend=-1))
                    spans[row + k] = [{"lang": names[label[a + x]], "first_word": int(x), "words": int(y - x)} for x, y in zip(turns, np.append(turns[1:], b - a))]
            out = [*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(out, [*kept, "lang_pred", "score", "spans"])

    return run


def label_languages(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, key1, key2, lang_pred, score, spans) of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *KEY]
    schema = "doc_id long, key1 long, key2 long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,words:long>>"
    return keyed(docs).select(*kept, "text").mapInArrow(_labeller(shared, kept), schema)


def _fitted(docs: DataFrame) -> dict:
    return fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows of ``docs`` that aren't held out and labels all: doc_id, held_out, lang_pred,
    score, spans."""
    return label_languages(docs, _fitted(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows whose language can be told from their text, all columns."""
    return without(docs, label_languages(docs, _fitted(docs)).where(F.col("lang_pred") == "und"))
