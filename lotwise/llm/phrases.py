"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are split into pieces at punctuation and line ends and pieces into words. Every word has two
independent 64-bit hashes; a phrase's fingerprint is the polynomial over the first hashes of its words,
taken for all n-grams at once from prefix polynomials, mixed with its language and tagged with its
length; its check is the same over the second hashes.

1. A scan for each length counts n-grams, words first. A phrase can only be frequent if the phrases inside
   it are, so a scan leaves out n-grams that begin or end with a shorter one (by a word) whose bit is not
   set in a table of FILTER_BITS bits. The table has a fixed size: where very many phrases are
   frequent it saves less, results are the same. Tasks add up what they find FLUSH n-grams at a time.
2. The shuffle brings fingerprints together, each with an occurrence pointer (34 bits of the text's hash, 30
   of the word's number) and, in one number, its check and count: 24 bytes a row, already added up by the
   tasks, so nothing is added up again before it. Behind it stand the count, the least pointer and the
   least and greatest check. Fingerprints with enough occurrences remain.
3. Where the two checks of a fingerprint differ several texts share it. All texts are scanned for these
   fingerprints and their occurrences are counted by their words.
4. Frequent phrases only are materialised: their pointers are joined with the documents, of equal texts
   one, and the words at the place are taken if they have the fingerprint and the check.
5. Parts of phrases are looked up by fingerprint and check. Scores, what lies in a longer phrase, and the
   ranks per language are joins, groupings and two windows, over parts of a language and over languages,
   that keep the first ``top`` of each. All arithmetic is in decimals or whole numbers.

Results for odd rows: null and empty texts have no words, a null lang is ``und`` and one with rows of that
name; A-Z only are lower-cased; a text of any length is read whole; rows that repeat a doc_id, or as a
whole, count each; doc_id is not read; languages without candidates have no rows; an empty table gives an
empty result; columns other than text and lang are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, OTHER_BYTES, broadcast_if_small, mix64, small_batches, span_hashes, stored, text_pieces, word_bounds

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE = 2_000_000
#: A phrase goes if a longer one around it has at least this percentage of its occurrences.
INSIDE = 80
#: Characters between the words of a piece, and between pieces.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bits of the tables of frequent phrases of a length: 16 MB each.
FILTER_BITS = 1 << 27
#: N-grams that a task adds up at once, and words whose polynomials are taken at once.
FLUSH, RUN_WORDS = 3_000_000, 1 << 18
#: Parts of a language that are ranked by themselves first.
PARTS_RANKED = 32
#: Bits of a pointer for the word's number, and of a fingerprint for its length.
PLACE_BITS, TAG_BITS = 30, 3
#: Fingerprints can be made shorter to try collisions.
FINGERPRINT_BITS = 64

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(BREAKS)] = True
NO_WORD = IS_BREAK.copy()
NO_WORD[list(GAPS)] = True

#: The parts of a phrase of n words as (first word, words): all that are shorter.
PARTS = {n: [(k, size) for size in range(1, n) for k in range(n - size + 1)] for n in range(2, LONGEST + 1)}

_BASES = (np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC6A4A7935BD1E995 | 1))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)

COUNTS = "fp long, at long, packed long"
#: Bits of a count, below those of the check, in ``packed``.
COUNT_BITS = 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Fingerprints and checks of the n-grams of a run of words, from prefix polynomials."""

    def __init__(self, hashes: tuple[np.ndarray, np.ndarray], seeds: np.ndarray):
        self.words, self.seeds, self.prefix, self.back = len(seeds), seeds, [], []
        for h, base, inverse in zip(hashes, _BASES, _INVERSES):
            prefix = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * powers(base, len(h)), out=prefix[1:])
            self.prefix.append(prefix)
            self.back.append(powers(inverse, len(h)))

    def _polynomial(self, k: int, size: int, at: np.ndarray) -> np.ndarray:
        return (self.prefix[k][at + size] - self.prefix[k][at]) * self.back[k][at]

    def fingerprints(self, size: int, at: np.ndarray) -> np.ndarray:
        fp = mix64(self._polynomial(0, size, at) ^ self.seeds[at])
        if FINGERPRINT_BITS < 64:
            fp &= np.uint64((1 << FINGERPRINT_BITS) - 1)
        return (fp << np.uint64(TAG_BITS)) | np.uint64(size)

    def checks(self, size: int, at: np.ndarray) -> np.ndarray:
        return mix64(self._polynomial(1, size, at) + self.seeds[at]) >> np.uint64(COUNT_BITS)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, first hash, second hash, piece) of the words of concatenated texts."""
    begins, ends = word_bounds(data, offsets[:-1], NO_WORD)
    piece = np.cumsum(IS_BREAK[data], dtype=np.int64)[begins] if len(data) else begins
    return begins, ends, span_hashes(data, begins, ends), span_hashes(data, begins, ends, OTHER_BYTES), piece


def runs(batch, with_text: bool = False):
    """Yields (rows, hashes, second hashes, pieces, numbers, words, again) for runs of the words of a batch:
    the row of each word, the piece it stands in (no two rows share one) and its number in its text. The last
    LONGEST - 1 words of a run of a long text come again at the start of the next; ``again`` says how many."""
    held = None
    for row, data, offsets, more in text_pieces(batch.column("text")):
        begins, ends, h, other, piece = words_of(data, offsets)
        doc = np.searchsorted(offsets, begins, side="right") - 1
        first = np.searchsorted(begins, offsets)
        rows, piece, number = doc + row, piece + doc, np.arange(len(begins)) - first[doc]
        words = [data[a:b].tobytes() for a, b in zip(begins, ends)] if with_text else []
        parts, again = [rows, h, other, piece, number], 0
        if held is not None:  # the text goes on
            last, broken, tail, tail_words = held
            parts[3], parts[4] = piece + broken, number + last
            parts = [np.concatenate(x) for x in zip(tail, parts)]
            again, words = len(tail[0]), tail_words + words
        if more:
            keep = max(0, len(parts[0]) - LONGEST + 1)
            last = (held[0] if held else 0) + len(begins)
            broken = (held[1] if held else 0) + int(IS_BREAK[data].sum())
            held = (last, broken, [x[keep:] for x in parts], words[keep:])
        else:
            held = None
        yield *parts, words, again


def _in_table(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = (fp >> np.uint64(TAG_BITS)) & np.uint64(FILTER_BITS - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def places(grams: Grams, piece: np.ndarray, sizes: tuple, table: np.ndarray | None, again: int) -> dict[int, np.ndarray]:
    """Where n-grams of these sizes begin: inside one piece, not wholly in the ``again`` first words, and
    with all inner phrases, which are of one size, in the table."""
    inner = min(sizes) - 1
    good = None
    if table is not None:
        good = np.zeros(grams.words, dtype=bool)
        at = np.flatnonzero(piece[: grams.words - inner + 1] == piece[inner - 1 :]) if inner > 1 else np.arange(grams.words)
        good[at[_in_table(table, grams.fingerprints(inner, at))]] = True
    out = {}
    for size in sizes:
        last = grams.words - size + 1
        if last <= 0:
            out[size] = np.empty(0, np.int64)
            continue
        ok = piece[:last] == piece[size - 1 :]
        ok[: max(0, again - size + 1)] = False
        if good is not None:
            for k in range(size - inner + 1):
                ok &= good[k : k + last]
        out[size] = np.flatnonzero(ok)
    return out


def _segments(rows, *arrays):
    """Runs of at most RUN_WORDS words, each with the last words of the one before."""
    words, again = len(rows), arrays[-1]
    start = 0
    while start < words:
        stop = min(words, start + RUN_WORDS)
        yield rows[start:stop], *(x[start:stop] for x in arrays[:-1]), again
        if stop == words:
            return
        start, again = stop - LONGEST + 1, LONGEST - 1


def _summed(parts: list) -> list[np.ndarray]:
    """(fp, at, packed) with equal neighbours added up; checks of a fingerprint are rows each."""
    fp, at, check = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(fp)
    fp, at, check = fp[order], at[order], check[order]
    begins = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]) if len(fp) else np.empty(0, np.int64)
    if not len(begins):
        return [np.empty(0, np.int64)] * 3
    n = np.diff(np.r_[begins, len(fp)]).astype(np.uint64)
    return [fp[begins].view(np.int64), np.minimum.reduceat(at, begins), (check[begins].astype(np.uint64) << np.uint64(COUNT_BITS) | n).view(np.int64)]


def _counted(sizes: tuple, table):
    def run(batches):
        import pyarrow as pa

        bits = table.value if table is not None else None
        held, waiting, totals = [], 0, {}

        def sums():
            columns = _summed(held)
            if totals:  # the words of each language, under its own key with length 0
                own = np.array(list(totals), np.uint64) << np.uint64(TAG_BITS)
                columns = [np.concatenate(x) for x in zip(columns, (own.view(np.int64), np.zeros(len(own), np.int64), np.array(list(totals.values()), np.int64)))]
            for k in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 17)]) for x in columns], ["fp", "at", "packed"])

        for batch in batches:
            seeds, texts = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("lang_key", "text_key"))
            for rows, h, other, piece, number, _, again in runs(batch):
                for rows_, h_, other_, piece_, number_, again_ in _segments(rows, h, other, piece, number, again):
                    grams = Grams((h_, other_), seeds[rows_])
                    for size, at in places(grams, piece_, sizes, bits, again_).items():
                        held.append((grams.fingerprints(size, at), pointers(texts[rows_[at]], number_[at]), grams.checks(size, at).astype(np.uint32)))
                        waiting += len(at)
                        if size == 1:
                            for seed, n in zip(*(x.tolist() for x in np.unique(seeds[rows_[at]], return_counts=True))):
                                totals[seed] = totals.get(seed, 0) + n
                    if waiting >= FLUSH:
                        yield from sums()
                        held, waiting, totals = [], 0, {}
        if waiting:
            yield from sums()

    return run


def pointers(text_keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """34 bits of the text's hash and 30 of the number of the word: a text of 2 GB has no more words."""
    return ((text_keys >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | numbers.astype(np.uint64)).view(np.int64)


def _told_apart(colliding):
    """(fp, check, phrase, n, at): occurrences of colliding fingerprints by their words, from each batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seeds, texts = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("lang_key", "text_key"))
            out: dict = {}
            for rows, h, other, piece, number, words, again in runs(batch, with_text=True):
                start = 0
                for rows_, h_, other_, piece_, number_, again_ in _segments(rows, h, other, piece, number, again):
                    grams = Grams((h_, other_), seeds[rows_])
                    for size in range(1, LONGEST + 1):
                        at = places(grams, piece_, (size,), None, again_)[size]
                        fp = grams.fingerprints(size, at)
                        hit = _in_table(colliding.value, fp)
                        at, fp = at[hit], fp[hit].view(np.int64)
                        for k, a, b, pointer in zip(at.tolist(), fp.tolist(), grams.checks(size, at).view(np.int64).tolist(), pointers(texts[rows_[at]], number_[at]).tolist()):
                            key = (a, b, b" ".join(words[start + k : start + k + size]).lower())
                            n, least = out.get(key, (0, pointer))
                            out[key] = (n + 1, min(least, pointer))
                    start += len(rows_) - LONGEST + 1
            columns = [*(zip(*out) if out else ((), (), ())), *(zip(*out.values()) if out else ((), ()))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["fp", "check", "phrase", "n", "at"])

    return run


def bit_table(frequent: DataFrame):
    """The broadcast table of the fingerprints' bits: FILTER_BITS / 8 bytes, however many there are."""
    bit = F.shiftright("fp", TAG_BITS).bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = frequent.select(F.shiftright(bit, 5).cast("int").alias("slot"), F.expr(f"shiftleft(1L, CAST((fp >> {TAG_BITS}) & 31 AS INT))").alias("bit"))
    rows = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows
    table = np.zeros(max(1, FILTER_BITS // 32), dtype="<u4")
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return frequent.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def frequent_grams(rows: DataFrame, sizes: tuple, table, least: int) -> DataFrame:
    """(fp, check, n, at) of the n-grams of these sizes with at least ``least`` occurrences."""
    check = F.shiftrightunsigned("packed", COUNT_BITS)
    once = rows.mapInArrow(_counted(sizes, table), COUNTS).repartition("fp")
    counted = once.groupBy("fp").agg(F.sum(F.col("packed").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))).alias("n"), F.min("at").alias("at"), F.min(check).alias("low"), F.max(check).alias("high"))
    counted = stored(counted.where(F.col("n") >= least), "grams")
    clear = counted.where("low = high").select("fp", F.col("low").alias("check"), "n", "at")
    shared = counted.where("low != high")
    if not shared.limit(1).count():
        return clear
    return stored(clear.unionByName(by_text(rows, shared, least)), "told_apart")


def by_text(rows: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(fp, check, n, at) of the phrases that share the given fingerprints, counted by their words."""
    found = rows.mapInArrow(_told_apart(bit_table(shared)), "fp long, check long, phrase binary, n long, at long").join(shared.select("fp"), "fp", "left_semi")
    told = found.groupBy("fp", "check", "phrase").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    return told.where(F.col("n") >= least).drop("phrase")


def _materialised(batches):
    """(fp, check, lang, phrase, parts, part_checks) of the phrases wanted from each text."""
    import pyarrow as pa

    for batch in batches:
        seeds = batch.column("lang_key").to_numpy(zero_copy_only=False).view(np.uint64)
        wanted = batch.column("wanted")
        number_all, fp_all, check_all = (wanted.values.field(c).to_numpy() for c in ("number", "fp", "check"))
        cuts, langs = wanted.offsets.to_numpy(), batch.column("lang").to_pylist()
        out = []
        for rows, h, other, piece, number, words, again in runs(batch, with_text=True):
            for row in np.unique(rows):
                own = np.flatnonzero(rows == row)
                lo = own[0]
                grams = Grams((h[own], other[own]), seeds[rows[own]])
                mine = slice(cuts[row], cuts[row + 1])
                at, size = number_all[mine].astype(np.int64) - number[lo], fp_all[mine] & ((1 << TAG_BITS) - 1)
                for n in range(2, LONGEST + 1):
                    here = np.flatnonzero((size == n) & (at >= 0) & (at + n <= len(own)))
                    place = at[here]
                    right = (grams.fingerprints(n, place).view(np.int64) == fp_all[mine][here]) & (grams.checks(n, place).view(np.int64) == check_all[mine][here])
                    here, place = here[right], place[right]
                    parts = [(grams.fingerprints(m, place + k).view(np.int64), grams.checks(m, place + k).view(np.int64)) for k, m in PARTS[n]]
                    for j, (i, p) in enumerate(zip(here.tolist(), place.tolist())):
                        phrase = b" ".join(words[lo + p : lo + p + n]).lower()
                        out.append((int(fp_all[mine][i]), int(check_all[mine][i]), langs[row], phrase.decode("utf-8"), [int(x[j]) for x, _ in parts], [int(x[j]) for _, x in parts]))
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["fp", "check", "lang", "phrase", "parts", "part_checks"])


def materialised(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(fp, check, a, lang, phrase, parts, part_checks) of the frequent phrases."""
    text_place = lambda c: F.shiftrightunsigned(c, PLACE_BITS)
    one = F.struct(F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("number"), "fp", "check")
    wanted = stored(frequent.select(text_place("at").alias("place"), one.alias("one")).groupBy("place").agg(F.collect_list("one").alias("wanted")), "wanted")
    ids = broadcast_if_small(stored(wanted.select("place"), "wanted_ids"), BROADCAST_IDS)
    texts = rows.withColumn("place", text_place("text_key")).join(ids, "place", "left_semi")
    # of equal texts one is read
    texts = stored(texts.groupBy("place", "text_key", "lang_key").agg(F.first("lang").alias("lang"), F.first("text").alias("text")), "wanted_texts")
    found = texts.join(wanted, "place").select("lang", "lang_key", "text", "wanted")
    found = found.mapInArrow(_materialised, "fp long, check long, lang string, phrase string, parts array<long>, part_checks array<long>")
    counts = frequent.select("fp", "check", F.col("n").alias("a"))
    return stored(found.dropDuplicates(["fp", "check"]).join(counts, ["fp", "check"]), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("lang", "text", F.xxhash64("lang").alias("lang_key"), F.xxhash64("lang", "text").alias("text_key"))
    single = frequent_grams(rows, (1,), None, least)
    pairs = frequent_grams(rows, (2,), bit_table(single), least)
    three = frequent_grams(rows, (3,), bit_table(pairs), least)
    longer = three.unionByName(frequent_grams(rows, (LONGEST,), bit_table(three), least))
    return ranked(materialised(rows, pairs.unionByName(longer)), single.unionByName(pairs).unionByName(longer), top)


def part_index(n: int, k: int, size: int) -> int:
    return PARTS[n].index((k, size))


def ranked(phrases: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    """Scores, drops and ranks of materialised phrases; ``counts`` has (fp, check, n) of all frequent n-grams
    and of the languages."""
    key = ["fp", "check"]
    size = F.col("fp").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).cast("int")
    rows = phrases.withColumn("size", size)

    def part(k: int) -> F.Column:
        return F.struct(F.get("parts", F.lit(k)).alias("fp"), F.get("part_checks", F.lit(k)).alias("check"))

    # every cut: its number and its two parts
    cut = lambda n: F.array(*(F.struct(F.lit(k).alias("k"), part(part_index(n, 0, k)).alias("left"), part(part_index(n, k, n - k)).alias("right")) for k in range(1, n)))
    cuts = F.when(F.col("size") == 2, cut(2)).when(F.col("size") == 3, cut(3)).otherwise(cut(4))
    each = rows.select(*key, "a", F.explode(cuts).alias("c")).select(*key, "a", "c.*")
    side = lambda name, as_: counts.select(F.struct(*key).alias(name), F.col("n").alias(as_))
    each = each.join(side("left", "l"), "left").join(side("right", "r"), "right")
    each = each.withColumn("score", F.expr(f"(CAST({SCALE} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0))) div CAST(l + r AS DECIMAL(20,0))"))
    lowest = each.groupBy(*key).agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(*key, "c.score", "c.l", "c.r")
    # the parts of longer phrases, each with its greatest number of occurrences around it
    inner = lambda n: F.array(*(part(i) for i, (_, m) in enumerate(PARTS[n]) if m > 1))
    around = rows.where("size > 2").select("a", F.explode(F.when(F.col("size") == 3, inner(3)).otherwise(inner(4))).alias("p")).groupBy("p").agg(F.max("a").alias("around"))
    kept = rows.join(around.select("p.fp", "p.check", "around"), key, "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * INSIDE))
    language = F.shiftleft(F.xxhash64("lang"), TAG_BITS)
    words = counts.where(F.col("fp").bitwiseAND(F.lit((1 << TAG_BITS) - 1)) == 0).select(F.col("fp").alias("language"), "n")
    scored = kept.select(*key, "lang", "phrase", "a").join(lowest, key).withColumn("language", language).join(broadcast_if_small(stored(words, "languages"), BROADCAST_IDS), "language")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part of a language first: its last task gets PARTS_RANKED * top rows at most
    part = F.pmod(F.shiftright("fp", TAG_BITS), F.lit(PARTS_RANKED))
    scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM g WHERE k > 1),
s AS (SELECT c.lang, c.g, c.k, c.f AS a, cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN g x ON x.lang = c.lang AND x.k = cut AND x.g = array_to_string(c.w[1:cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.k = c.k - cut AND y.g = array_to_string(c.w[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS g, max(f) AS f FROM (SELECT lang, w, f, k, m, unnest(range(1, k - m + 2)) AS o FROM c, range(2, 4) r(m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER best AS rank, g AS phrase, a, l, r, n, score FROM b JOIN total USING (lang) LEFT JOIN i USING (lang, g) WHERE i.f IS NULL OR 100 * i.f < 80 * a
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, g) QUALIFY rank <= 2000
"""
