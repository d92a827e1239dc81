"""Benchmark decontamination: a prefix-filtered set join between windows of items and documents.

1. Items are cut into windows of WINDOW consecutive words (an item of fewer words is one window). A
   window is the set of its shingles of SHINGLE words; one that is shorter is its own shingle.
2. The shingles of the items are counted over all documents, and each window's are ordered by rarity.
   To hold a window a document has to hold all of its shingles, so the prefix that has to be joined is
   one token: the rarest.
3. Documents are scanned for prefix tokens. An occurrence at word p of a token that stands at place o of
   a window leaves one candidate, words p - o to p - o + length: it has to lie inside the document (the
   bounds of length and position), and then its words are compared with the window's, one by one.
4. Spans and items of a document are merged: words inside any of its spans are hit.

Items are read in blocks of about BLOCK_BYTES of text, chosen by hash, so what is sent to all tasks is
bounded however many items there are; each further block costs two more scans of the documents. What a
block finds is carried by a 128-bit hash of doc_id and text. Words are compared by 64-bit hashes, a
window of ten by ten of them. Documents are never shuffled where one block holds all items.

Results for odd rows: null, empty and wordless texts have no words and no hits, and such items have no
windows; rows that repeat a doc_id are documents each; rows that repeat an item_id are one item of several
texts, null is an item_id of its own, written ``null``; a document of any length is read whole; with no
items or no documents nothing is hit; columns other than the four named are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, NOT_TERM, keyed, mix64, run_words, small_batches, stored

WINDOW, SHINGLE = 10, 3
#: Bytes of item texts that are looked for at once.
BLOCK_BYTES = 16 << 20
#: Bits of the table that says quickly that a shingle is no token; a power of 2.
FILTER_BITS = 1 << 22

FOUND = "doc_id long, key1 long, key2 long, n_words long, spans array<struct<first:int,stop:int>>, items array<string>"


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on, for all but the last size - 1."""
    last = len(words) - size + 1
    if last <= 0:
        return np.empty(0, np.uint64)
    out = words[:last]
    for k in range(1, size):
        x = words[k : k + last]
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + (x ^ (x >> np.uint64(29))))
    return out


class Windows:
    """The distinct windows of a block of items, by length, with the items that have them."""

    def __init__(self, ids: list[str], words: list[np.ndarray]):
        names = sorted(set(ids))
        number = {name: k for k, name in enumerate(names)}
        by_length: dict[int, list] = {}
        for name, w in zip(ids, words):
            if len(w):
                length = min(WINDOW, len(w))
                rows = np.lib.stride_tricks.sliding_window_view(w, length)
                by_length.setdefault(length, []).append((rows, np.full(len(rows), number[name])))
        self.names = np.array(names, dtype=object)
        self.words, self.item_cuts, self.items = {}, {}, {}
        for length, parts in by_length.items():
            rows = np.concatenate([p[0] for p in parts])
            rows, at = np.unique(rows, axis=0, return_inverse=True)
            owners = np.unique(np.stack([at.reshape(-1), np.concatenate([p[1] for p in parts])], axis=1), axis=0)
            self.words[length] = rows
            self.item_cuts[length] = np.searchsorted(owners[:, 0], np.arange(len(rows) + 1))
            self.items[length] = owners[:, 1]

    def shingles(self, length: int) -> np.ndarray:
        """A row of shingles for each window of this length."""
        size, rows = min(SHINGLE, length), self.words[length]
        return np.stack([shingles(rows[:, k : k + size].reshape(-1), size)[::size] for k in range(length - size + 1)], axis=1)

    def vocabulary(self) -> dict[int, np.ndarray]:
        """The distinct shingles by their size."""
        sizes: dict[int, list] = {}
        for length in self.words:
            sizes.setdefault(min(SHINGLE, length), []).append(self.shingles(length).reshape(-1))
        return {size: np.unique(np.concatenate(x)) for size, x in sizes.items()}

    def prefixes(self, counts: dict[int, int]) -> list[tuple]:
        """For each length (length, shingle size, sorted tokens, cuts, windows, places): windows and
        places[cuts[k] : cuts[k + 1]] are those whose rarest shingle is tokens[k], and where it stands."""
        out = []
        for length in sorted(self.words):
            own = self.shingles(length)
            flat, at = np.unique(own, return_inverse=True)
            rarity = np.array([counts.get(int(x), 0) for x in flat.view(np.int64)], dtype=np.int64)[at].reshape(own.shape)
            place = rarity.argmin(axis=1)
            token = own[np.arange(len(own)), place]
            order = np.argsort(token, kind="stable")
            tokens, begins = np.unique(token[order], return_index=True)
            out.append((length, min(SHINGLE, length), tokens, np.r_[begins, len(order)], order, place[order]))
        return out


def quick(tokens: np.ndarray) -> np.ndarray:
    """A table of booleans by the low bits of hashes: False where there is none of these."""
    table = np.zeros(FILTER_BITS, dtype=bool)
    table[tokens & np.uint64(FILTER_BITS - 1)] = True
    return table


def places_of(grams: np.ndarray, tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``grams`` has one of the sorted ``tokens``, and which."""
    maybe = np.flatnonzero(table[grams & np.uint64(FILTER_BITS - 1)])
    k = np.searchsorted(tokens, grams[maybe])
    k[k == len(tokens)] = 0
    right = tokens[k] == grams[maybe]
    return maybe[right], k[right]


def spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of begins[k] .. ends[k] - 1 in a row, and the k of each."""
    width = ends - begins
    who = np.repeat(np.arange(len(width)), width)
    return np.repeat(begins - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum()), who


def _counted(vocabulary):
    """Counts of the items' shingles, from each task once."""

    def run(batches):
        import pyarrow as pa

        sizes = {size: (tokens, quick(tokens), np.zeros(len(tokens), np.int64)) for size, tokens in vocabulary.value.items()}
        for batch in batches:
            for _, words, cuts in run_words(batch.column("text"), NOT_TERM):
                owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                for size, (tokens, table, counts) in sizes.items():
                    grams = shingles(words, size)
                    grams = grams[owner[: len(grams)] == owner[size - 1 :]] if size > 1 else grams
                    _, k = places_of(grams, tokens, table)
                    counts += np.bincount(k, minlength=len(tokens))
        for tokens, _, counts in sizes.values():
            seen = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(tokens[seen].view(np.int64)), pa.array(counts[seen])], ["token", "n"])

    return run


def occurrences(words: np.ndarray, cuts: np.ndarray, windows: Windows, prefixes: list, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind the last, item) of every occurrence of a window in the run of documents
    that ``cuts`` gives, for each item that has the window."""
    found = [np.empty((3, 0), np.int64)]
    bounds = np.empty((2, len(words)), np.int64)
    bounds[0], bounds[1] = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    for (length, size, tokens, token_cuts, rows, places), table in zip(prefixes, tables):
        at, k = places_of(shingles(words, size), tokens, table)
        which, who = spread(token_cuts[k], token_cuts[k + 1])
        at, first = at[who], at[who] - places[which]
        inside = first >= bounds[0][at]
        inside &= first + length <= bounds[1][at]
        first, rows_found = first[inside], rows[which[inside]]
        target = windows.words[length]
        for j in range(length):
            same = words[first + j] == target[rows_found, j]
            first, rows_found = first[same], rows_found[same]
        item_cuts = windows.item_cuts[length]
        which, who = spread(item_cuts[rows_found], item_cuts[rows_found + 1])
        found.append(np.stack([first[who], first[who] + length, windows.items[length][which]]))
    return tuple(np.concatenate(found, axis=1))


def merged(first: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch inside a document as one, ordered by (doc, first)."""
    if not len(first):
        return first, stop, doc
    order = np.lexsort((first, doc))
    first, stop, doc = first[order], np.maximum.accumulate(stop[order]), doc[order]  # documents stand in a row
    new = np.r_[True, (first[1:] > stop[:-1]) | (doc[1:] != doc[:-1])]
    begins = np.flatnonzero(new)
    return first[begins], stop[np.r_[begins[1:], len(new)] - 1], doc[begins]


def _scanned(block, only_hits: bool):
    def run(batches):
        import pyarrow as pa

        windows, prefixes = block.value
        tables = [quick(p[2]) for p in prefixes]
        span = pa.struct([("first", pa.int32()), ("stop", pa.int32())])
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            spans, items = [np.empty((3, 0), np.int64)], [np.empty((2, 0), np.int64)]
            for row, words, cuts in run_words(batch.column("text"), NOT_TERM):
                n[row : row + len(cuts) - 1] = np.diff(cuts)
                first, stop, item = occurrences(words, cuts, windows, prefixes, tables)
                if len(first):
                    doc = np.searchsorted(cuts, first, side="right") - 1
                    items.append(np.unique(np.stack([doc + row, item]), axis=1))
                    first, stop, doc = merged(first, stop, doc)
                    spans.append(np.stack([first - cuts[doc], stop - cuts[doc], doc + row]))
            spans, items = np.concatenate(spans, axis=1), np.concatenate(items, axis=1)
            rows = np.arange(batch.num_rows + 1)
            span_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(spans[2], rows).astype(np.int32)), pa.StructArray.from_arrays([pa.array(spans[0].astype(np.int32)), pa.array(spans[1].astype(np.int32))], fields=list(span)))
            item_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(items[0], rows).astype(np.int32)), pa.array(windows.names[items[1]].tolist(), pa.string()))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *KEY)), pa.array(n), span_lists, item_lists], ["doc_id", *KEY, "n_words", "spans", "items"])
            if only_hits:
                out = out.filter(pa.array(np.isin(rows[:-1], spans[2])))
            yield out

    return run


def block_windows(items: DataFrame, blocks: int, number: int) -> Windows:
    """The windows of one block of items: bounded by the number of blocks."""
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).select("item", "text").toArrow()
    words: list = [None] * own.num_rows
    if own.num_rows:
        for row, hashes, cuts in run_words(own.column("text"), NOT_TERM):
            for k in range(len(cuts) - 1):
                words[row + k] = hashes[cuts[k] : cuts[k + 1]]
    return Windows(own.column("item").to_pylist(), words)


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["first"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def found_in(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key1, key2, n_words, spans, items): what every document holds of the items; spans are
    word numbers from 0, the end exclusive."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs)
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    whole, more = None, []
    for number in range(blocks):
        windows = block_windows(items, blocks, number)
        vocabulary = windows.vocabulary()
        counts: dict[int, int] = {}
        if vocabulary:
            counted = rows.select("text").mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), "token long, n long")
            counts = {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
        block = spark.sparkContext.broadcast((windows, windows.prefixes(counts)))
        found = rows.mapInArrow(_scanned(block, only_hits=number > 0), FOUND)
        if number == 0:
            whole = found
        else:
            more.append(stored(found, "hits"))
    if not more:
        return whole
    rest = more[0]
    for part in more[1:]:
        rest = rest.unionByName(part)
    rest = stored(rest.groupBy(KEY).agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items")), "more_hits")
    both = whole.join(rest, KEY, "left")
    plus = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b)).alias(a)
    return both.select("doc_id", *KEY, "n_words", plus("spans", "more_spans"), plus("items", "more_items"))


def contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = found_in(docs, items, block_bytes)
    names = F.sort_array(F.array_distinct("items"))
    hit = covered(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda k: array_to_string(w[k + 1:k + 10], ' '))) AS g FROM i WHERE len(w) > 0),
p AS (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM v))),
o AS (SELECT r, n, pos, item FROM p JOIN v USING (n, g)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS q FROM o) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
