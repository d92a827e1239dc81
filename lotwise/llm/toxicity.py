"""Toxic severity by cumulative-link ordinal regression on sparse words.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight for each word, shared by all ordered
thresholds. x marks the presence of words (runs of letters, A-Z lower-cased) and of word beginnings.
The result for a text is its expected grade, its likeliest grade and whether the chance of a grade
above 0 reaches CUT.

The model is fitted on a bounded sample of labelled rows, about SAMPLE_DOCS drawn by hash (fewer rows:
all). Every grade has an equal part of the sample, what rare grades leave goes to the others, and rows
weigh as many as they stand for. Features are the up to FEATURES words that tell grade 0 from the rest
most surely: by the hypergeometric tail, with few false ones expected among those chosen. Where no word
is that sure, the BEST surest ones are taken. All else covers every document and whole texts.

Labels that only tell toxic from not are graded by cross-fitting: the sample is halved, words are chosen
and a model of two grades is fitted on one half, and its scores cut the toxic rows of the other half into
SEVERITIES equal parts. So no row's grade is read off features that were chosen on it. Such grades order
the toxic rows by how plainly toxic they are to a model that has not seen them; they are no judgement of
people, and only labels with grades of their own give that.

Results for odd rows: a null or empty text has no words and gets what the thresholds alone say; if
no row is labelled, or all have one grade, every text gets that grade (0 without labels); if the
labelled texts hold no words at all every text gets what the thresholds alone say; several
labels of a document count as the highest; rows that repeat a doc_id are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, prefix_hashes, row_key, small_batches, stored, text_pieces
from .langid import _PLAIN, held_out

SAMPLE_DOCS = 20_000
#: Features of a word: itself and its first bytes, for families of words that share a stem.
KINDS = (None, 4, 5, 6, 7, 8)
#: Of the chosen features, at most FALSE_SHARE and at most FALSE_WORDS are expected to differ by chance.
#: Their smoothed odds ratio is at least ODDS: with many labels, words that hardly tell anything are
#: significant too.
FEATURES, FALSE_SHARE, FALSE_WORDS, ODDS = 2000, 0.1, 3, 3.0
#: Words to take where none is that sure.
BEST = 20
#: Logarithms of chances are counted in steps of 1/BINS, down to -DEEPEST.
BINS, DEEPEST = 20, 500
STEPS, RATE, SHRINK = 400, 0.1, 1e-5
CUT = 0.1
#: Grades above 0 that labels of two grades are given.
SEVERITIES = 2


def _chunks(column):
    """(first row, features of the words of a piece of texts, one array a kind, words before each row, more).

    The kind, a word or one of its prefixes, stands in the low bits of a feature."""
    for row, data, offsets, more in text_pieces(column):
        kinds, begins = prefix_hashes(_PLAIN[data], offsets[:-1], KINDS)
        yield row, [(h & ~np.uint64(7)) | np.uint64(k) for k, h in enumerate(kinds)], np.searchsorted(begins, offsets), more


def _merged(found):
    """(row, distinct values) of each text, out of (row, values, more) of its pieces."""
    held = []
    for row, values, more in found:
        if more or held:
            held = [np.unique(np.concatenate([*held, values]))]
            if more:
                continue
            values, held = held[0], []
        yield row, values


def _words_of(column):
    """(row, sorted distinct features) of every text."""

    def found():
        for row, kinds, cuts, more in _chunks(column):
            for k in range(len(cuts) - 1):
                yield row + k, np.unique(np.concatenate([h[cuts[k] : cuts[k + 1]] for h in kinds])), more

    return _merged(found())


def _known_of(column, known: np.ndarray):
    """(row, places in ``known`` of the distinct features) of every text; ``known`` is sorted."""

    def found():
        for row, kinds, cuts, more in _chunks(column):
            owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            hits = []
            for h in kinds:
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                hits.append(owner[hit] * len(known) + at[hit])
            places = np.unique(np.concatenate(hits))
            ends = np.searchsorted(places, np.arange(len(cuts)) * len(known))
            for k in range(len(cuts) - 1):
                yield row + k, places[ends[k] : ends[k + 1]] % len(known), more

    return _merged(found())


def _counted(batches):
    """(half, word, docs, hits): documents with a word, and those of a grade above 0, batch by batch."""
    import pyarrow as pa

    for batch in batches:
        toxic, half = np.array(batch.column("grade").to_pylist()) > 0, batch.column("half").to_numpy(zero_copy_only=False)
        found = list(_words_of(batch.column("text")))
        for h in (0, 1):
            mine = [(row, w) for row, w in found if half[row] == h]
            flat = np.concatenate([w for _, w in mine]) if mine else np.empty(0, np.uint64)
            owner = np.repeat(np.array([row for row, _ in mine], dtype=np.int64), [len(w) for _, w in mine])
            words, code, docs = np.unique(flat, return_inverse=True, return_counts=True)
            hits = np.bincount(code, toxic[owner], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), h, np.int32)), pa.array(words.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(hits)], ["half", "word", "docs", "hits"])


def _featured(known: np.ndarray):
    """(grade, half, features): the places in ``known``, sorted hashes, of the words of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            features = [np.empty(0, np.int64)] * batch.num_rows
            for row, places in _known_of(batch.column("text"), known) if len(known) else ():
                features[row] = places
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("half"), pa.array(features, pa.list_(pa.int64()))], ["grade", "half", "features"])

    return run


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chances(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = j) for each score."""
    below = sigmoid(thresholds[None, :] - score[:, None])
    below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
    return np.maximum(np.diff(below, axis=1), 1e-12)


def quotas(held: dict, total: int) -> dict:
    """How many rows of each grade to draw: equal parts of ``total``, of which rare grades leave the
    rest to the others."""
    out, left = {}, total
    for k, grade in enumerate(sorted(held, key=lambda g: (held[g], g))):
        out[grade] = min(held[grade], left / (len(held) - k))
        left -= out[grade]
    return out


def log_factorial(n: np.ndarray) -> np.ndarray:
    m = np.maximum(n, 1.0)
    return np.where(n < 1, 0.0, m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3))


def log_tail(docs: np.ndarray, hits: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """A bound of the logarithm of the chance that a word in ``docs`` of ``rows`` documents is in
    ``hits`` or more of the ``positive`` ones: the chance of just ``hits``, and the rest of the tail as
    a geometric series. 0 where hits are not above what is expected."""
    rows, positive = np.float64(rows), np.float64(positive)
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    point = choose(positive, hits) + choose(rows - positive, docs - hits) - choose(rows, docs)
    step = (positive - hits) * (docs - hits) / ((hits + 1) * (rows - positive - docs + hits + 1))
    return np.where(hits * rows <= docs * positive, 0.0, np.minimum(0.0, point - np.log1p(-np.minimum(step, 1 - 1e-9))))


def _judged(rows: int, positive: int):
    """(word, least, chance, odds, telling) of words: logarithms of the two-sided chance of a difference
    like theirs and of the largest that their number of documents allows, smoothed odds ratio."""

    def both(docs, hits):
        return np.minimum(log_tail(docs, hits, rows, positive), log_tail(docs, docs - hits, rows, rows - positive)) + np.log(2)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs, hits = (batch.column(c).to_numpy().astype(np.float64) for c in ("docs", "hits"))
            least = np.minimum(both(docs, np.minimum(docs, positive)), both(docs, np.maximum(0, docs - (rows - positive))))
            odds = (hits + 0.5) * (rows - positive - docs + hits + 0.5) / ((positive - hits + 0.5) * (docs - hits + 0.5))
            out = [batch.column("word"), least, both(docs, hits), np.maximum(odds, 1 / odds), hits * rows > docs * positive]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["word", "least", "chance", "odds", "telling"])

    return run


def telling_words(words: DataFrame, rows: int, positive: int) -> DataFrame:
    """(word, telling, chance) of the features, at most FEATURES, out of (word, docs, hits). Words whose
    chance is below a level t are chosen, the largest t at which the false ones, t times the words
    that are in documents enough to get there, are within FALSE_SHARE of the chosen
    and FALSE_WORDS; the BEST surest words if there is no such t."""
    everything = words.mapInArrow(_judged(rows, positive), "word long, least double, chance double, odds double, telling boolean")
    judged = stored(everything.where(F.col("least") < float(np.log(FALSE_SHARE))), "words")
    different = judged.where((F.col("odds") >= ODDS) & (F.col("chance") < 0))
    bin_of = lambda c: F.least(F.lit(DEEPEST * BINS), F.floor(-F.col(c) * BINS).cast("int"))

    def reaching(words, c):
        counts = np.zeros(DEEPEST * BINS + 1)
        for r in words.groupBy(bin_of(c).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["b"]] = r["n"]
        return counts[::-1].cumsum()[::-1]

    can, do = reaching(judged, "least"), reaching(different, "chance")
    level = np.exp(-np.arange(len(do)) / BINS)
    good = np.flatnonzero((do > 0) & (level * can <= np.minimum(FALSE_SHARE * do, FALSE_WORDS)))
    if len(good):
        return different.where(bin_of("chance") >= int(good[0])).orderBy("chance", "word").limit(FEATURES)
    return everything.orderBy("chance", F.desc("odds"), "word").limit(BEST)


def ordinal_loss(p, owner, feature, grade, features: int, weight) -> tuple[float, np.ndarray]:
    """(loss, gradient) at ``p``: weights, first threshold, logarithms of the steps to the others. The loss
    is the mean negative log-likelihood, rows weighing ``weight``, with a small penalty on the weights."""
    rows, grades = np.arange(len(grade)), int(grade.max()) + 1
    w, steps = p[:features], np.exp(p[features + 1 :])
    thresholds = p[features] + np.concatenate([[0], np.cumsum(steps)])
    score = np.bincount(owner, w[feature], len(grade))
    cdf = sigmoid(thresholds[None, :] - score[:, None])
    padded = np.concatenate([np.zeros((len(grade), 1)), cdf, np.ones((len(grade), 1))], axis=1)
    likely = np.maximum(padded[rows, grade + 1] - padded[rows, grade], 1e-9)
    slope = padded * (1 - padded)
    up, down = weight * slope[rows, grade + 1] / likely, weight * slope[rows, grade] / likely
    by_score = (up - down) / len(grade)
    by_threshold = np.bincount(grade + 1, -up, grades + 1)[1:grades] + np.bincount(grade, down, grades + 1)[1:grades]
    tail = np.cumsum((by_threshold / len(grade))[::-1])[::-1]
    gradient = np.concatenate([np.bincount(feature, by_score[owner], features) + SHRINK * w, tail[:1], tail[1:] * steps])
    return -float(weight @ np.log(likely)) / len(grade) + SHRINK / 2 * float(w @ w), gradient


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray, features: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on ``ordinal_loss``. Row ``owner[k]`` has feature ``feature[k]``; rows
    weigh ``weight``, or the same. Thresholds are a first one and positive steps, so they stay in order."""
    grades = int(grade.max()) + 1
    weight = np.ones(len(grade)) if weight is None else weight * (len(grade) / weight.sum())
    share = np.cumsum(np.bincount(grade, weight, grades))[:-1] / len(grade)
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        g = ordinal_loss(p, owner, feature, grade, features, weight)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1 :]))])


def cross_graded(owner, feature, grade, half, own: list[np.ndarray], weight, severities: int = SEVERITIES) -> np.ndarray:
    """Grades 0 to ``severities`` for rows of grade 0 and 1. ``own[h]`` marks the features chosen on half h;
    the rows of a half are scored by the model of the other one, and the toxic ones are cut into equal
    parts (by weight) at their scores; equal scores stay together."""
    score = np.zeros(len(grade))
    for h in (0, 1):
        use, known = half == h, own[h]
        if len(set(grade[use].tolist())) < 2 or not known.any():
            continue
        place, mine = np.cumsum(known) - 1, known[feature]
        here = mine & use[owner]
        row = np.cumsum(use) - 1
        w, _ = fit_ordinal(row[owner[here]], place[feature[here]], grade[use], int(known.sum()), weight[use])
        there = mine & ~use[owner]
        score += np.bincount(owner[there], w[place[feature[there]]], len(grade))
    toxic = np.flatnonzero(grade > 0)
    order = toxic[np.argsort(score[toxic], kind="stable")]
    below = np.cumsum(weight[order]) / weight[order].sum()
    cuts = [score[order[min(np.searchsorted(below, k / severities), len(order) - 1)]] for k in range(1, severities)]
    out = np.zeros(len(grade), dtype=np.int64)
    out[toxic] = 1 + np.searchsorted(cuts, score[toxic], "left")
    return np.searchsorted(np.unique(out), out) if (out == 0).any() else out


def fit(docs: DataFrame, grades: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model for ``grades`` (doc_id, grade from 0) as plain arrays."""
    small_batches(docs.sparkSession)
    grades = grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    grades = stored(grades, "grades")
    labelled = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {g: n / labelled[g] for g, n in quotas(labelled, sample_docs).items()}
    bar = lambda shares: F.coalesce(*(F.when(F.col("grade") == g, share * (1 << 30)) for g, share in shares.items()), F.lit(0.0))
    drawn = grades.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) < bar(shares))
    drawn = broadcast_if_small(stored(drawn, "drawn"), 2 * sample_docs)
    rows = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text"))[0].alias("key")).join(drawn, "doc_id")
    held = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        return {"words": np.empty(0, np.uint64), "weights": np.empty(0), "thresholds": np.empty(0), "only": max(held, key=held.get, default=0)}
    if sum(held.values()) > 2 * sample_docs:  # ids that very many rows repeat: draw again, by rows
        again = {g: n / held[g] for g, n in quotas(held, sample_docs).items()}
        rows = rows.where(F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(1 << 30)) < bar(again))
        shares = {g: share * again.get(g, 1.0) for g, share in shares.items()}
    rows = stored(rows.select("grade", F.pmod(F.shiftright("key", 32), F.lit(2)).cast("int").alias("half"), "text"), "labelled")
    counts = rows.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("grade") > 0, 1)).alias("positive")).collect()
    words = rows.mapInArrow(_counted, "half int, word long, docs long, hits long").groupBy("half", "word").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
    words = stored(words, "word_counts")
    both = words.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
    binary = set(held) == {0, 1}
    halves = [(r["half"], r["n"], r["positive"]) for r in counts if 0 < r["positive"] < r["n"]] if binary else []
    chosen = {h: _features(telling_words(words.where(F.col("half") == h).drop("half"), n, positive)) for h, n, positive in halves}
    best = _features(telling_words(both, sum(r["n"] for r in counts), sum(r["positive"] for r in counts)))
    known = np.unique(np.concatenate([best, *chosen.values()]))
    sample = rows.mapInArrow(_featured(known), "grade int, half int, features array<long>").toPandas()
    grade = sample["grade"].to_numpy(dtype=np.int64)
    weight = 1 / np.array([shares.get(g, 1.0) for g in range(int(grade.max()) + 1)])[grade]
    feature = np.concatenate([np.empty(0, np.int64), *sample["features"].to_list()]).astype(np.int64)
    owner = np.repeat(np.arange(len(grade)), sample["features"].map(len).to_numpy())
    if binary:
        own = [np.isin(known, chosen.get(h, np.empty(0, np.uint64))) for h in (0, 1)]
        grade = cross_graded(owner, feature, grade, sample["half"].to_numpy(), own, weight)
    use = np.isin(known, best)
    place, mine = np.cumsum(use) - 1, use[feature]
    weights, thresholds = fit_ordinal(owner[mine], place[feature[mine]], grade, int(use.sum()), weight)
    return {"words": known[use], "weights": weights, "thresholds": thresholds, "only": -1}


def _features(words: DataFrame) -> np.ndarray:
    return words.select("word").toPandas()["word"].to_numpy(dtype=np.int64).view(np.uint64)


def _scorer(model):
    def run(batches):
        import pyarrow as pa

        m = model.value
        known, weights = m["words"], m["weights"]
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, places in _known_of(batch.column("text"), known) if len(known) else ():
                score[row] = weights[places].sum()
            if m["only"] >= 0:
                p = np.zeros((len(score), m["only"] + 1))
                p[:, m["only"]] = 1
            else:
                p = chances(score, m["thresholds"])
            severity, toxic = p @ np.arange(p.shape[1]), p[:, 1:].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(p.argmax(axis=1), pa.int32()), pa.array(toxic), pa.array(toxic >= CUT)], ["doc_id", "severity", "grade", "chance", "toxic"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, severity, grade, chance, toxic) of every document; chance is that of a grade above 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, severity double, grade int, chance double, toxic boolean")


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled documents that aren't held out and scores all: doc_id, held_out,
    severity, grade, chance, toxic."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("grade")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "chance", "toxic")
