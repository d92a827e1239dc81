"""What the corpus operators share: stored intermediates, checked broadcasts, row keys, word kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.sources.storage import broadcast_if_small, discard, new_path, outlive, scratch, stored

__all__ = ["broadcast_if_small", "discard", "new_path", "outlive", "scratch", "stored"]

#: Whitespace that separates words, as byte values: space and \x09-\x0D.
SPACE_BYTES = (32, 9, 10, 11, 12, 13)
#: The same as a Java character class, and its complement.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Up to this many keys are broadcast to take their rows out.
BROADCAST_IDS = 1_000_000
KEY = ["key1", "key2"]
#: Bytes of an Arrow batch of texts, and rows that Parquet's reader decodes together. Spark's own defaults,
#: 64 MB and 4096 rows, hold tens of megabytes of texts for each task, in the JVM and again in each worker.
BATCH_BYTES, READER_ROWS = 1 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session, unless they are bounded more tightly."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """KEY, two 64-bit hashes of a row's doc_id and text, never null: rows have the same only if they
    have the same doc_id and text. Decisions on rows are carried by it."""
    return [F.xxhash64(F.lit(k), doc_id.isNull(), doc_id, text.isNull(), text).alias(name) for k, name in enumerate(KEY)]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key1, key2) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))


def without(docs: DataFrame, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose KEY is in ``gone``; of those that share a KEY in ``again`` only one
    stays, the least by its columns. While the keys are few enough to broadcast no text is shuffled.
    Columns of ``docs`` may have any names."""
    gone = broadcast_if_small(stored(gone.select(KEY).distinct(), "gone"), BROADCAST_IDS)
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    rows = docs.toDF(*own)
    rows = rows.select(*own, *row_key(F.col(at["doc_id"]).cast("long"), F.col(at["text"]).cast("string"))).join(gone, KEY, "left_anti")
    if again is not None:
        again = stored(again.select(KEY).distinct(), "again")
        if again.limit(1).count():
            again = broadcast_if_small(again, BROADCAST_IDS)
            plain = not any("map<" in kind or "variant" in kind for _, kind in docs.dtypes)
            one = (F.min if plain else F.first)(F.struct(*own)).alias("row")
            single = rows.join(again, KEY, "left_semi").groupBy(KEY).agg(one).select("row.*")
            rows = rows.join(again, KEY, "left_anti").select(*own).unionByName(single)
    return rows.select(*own).toDF(*docs.columns)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_count(text):
    """Number of words of a text; 0 for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


# -- word hashing over UTF-8 buffers -----------------------------------------------------------

_ODD = np.uint64(0x5851F42D4C957F2D)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Other values of the bytes, for a second hash of the same words.
OTHER_BYTES = np.random.default_rng(20260131).integers(1, 1 << 63, 256, dtype=np.uint64)
for _values in (_BYTE_VALUES, OTHER_BYTES):
    _values[65:91] = _values[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: Separators of terms: every ASCII character but digits and letters.
NOT_TERM = np.arange(256) < 128
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    NOT_TERM[_first : _last + 1] = False
#: Bytes of text that are worked on together.
PIECE_BYTES = 1 << 19
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases. Those for pieces of the usual size stay; longer ones, for a single word
    longer than that, do not."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size, tables = max(n, 2 * PIECE_BYTES), []
    for base in (_ODD, _ODD_INVERSE):
        t = np.full(size, base, dtype=np.uint64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if size == 2 * PIECE_BYTES:
        _powers[:] = tables
    return tables[0], tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, doc_starts: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of concatenated texts, and where each begins.

    ``data`` is the UTF-8 bytes, ``doc_starts`` the offsets at which texts begin, ``separators`` says
    which bytes are no part of words."""
    begins, ends = word_bounds(data, doc_starts, separators)
    return span_hashes(data, begins, ends), begins


def prefix_hashes(data: np.ndarray, doc_starts: np.ndarray, sizes: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """Like ``word_hashes``, for the first bytes of the words: an array for each of ``sizes``, in which
    shorter words stand as they are (None: all words do)."""
    begins, ends = word_bounds(data, doc_starts)
    stops = [ends if size is None else np.minimum(ends, begins + size) for size in sizes]
    return _many_hashes(data, begins, stops, _BYTE_VALUES), begins


def word_bounds(data: np.ndarray, doc_starts: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of concatenated texts begin and end."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~separators[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[doc_starts[doc_starts < n]] = True
    before = np.r_[False, solid[:-1]]
    begins = np.flatnonzero(solid & (~before | breaks[:-1]))
    after = np.r_[solid[1:], False]
    return begins, np.flatnonzero(solid & (~after | breaks[1:])) + 1


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """64-bit hashes of spans of bytes; ``values`` gives each byte its value."""
    return _many_hashes(data, begins, [ends], values)[0]


def _many_hashes(data: np.ndarray, begins: np.ndarray, stops: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    n = len(data)
    if n == 0:
        return [np.empty(0, np.uint64) for _ in stops]
    powers, inverses = _power_tables(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers[:n], out=prefix[1:])
    return [mix64((prefix[stop] - prefix[begins]) * inverses[begins] + (stop - begins).astype(np.uint64) * _MIX2) for stop in stops]


def text_pieces(column, piece_bytes: int = PIECE_BYTES):
    """Yields (first row, UTF-8 bytes, offsets, more) for runs of rows of an Arrow string column, null
    as empty, of about ``piece_bytes``. A longer text comes alone, in several pieces cut at white space
    (a word longer than that is not cut); ``more`` holds on all of these but its last."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        start = offsets[row]
        last = int(np.searchsorted(offsets, start + piece_bytes, side="right")) - 1
        last = min(max(last, row + 1), rows)
        if offsets[last] - start <= 2 * piece_bytes:
            yield row, data[start : offsets[last]], offsets[row : last + 1] - start, False
        else:
            text, at = data[start : offsets[last]], 0
            while at < len(text):
                stop = _white_space(text, at + piece_bytes, piece_bytes)
                yield row, text[at:stop], np.array([0, stop - at]), stop < len(text)
                at = stop
        row = last


def _white_space(text: np.ndarray, at: int, step: int) -> int:
    """Where the first white space from ``at`` on stands, or the end."""
    while at < len(text):
        gaps = np.flatnonzero(_IS_SPACE[text[at : at + step]])
        if len(gaps):
            return at + int(gaps[0])
        at += step
    return len(text)


def run_words(column, separators: np.ndarray, piece_bytes: int = PIECE_BYTES):
    """Yields (first row, word hashes, cuts) for runs of rows of an Arrow string column: the words of
    the run's k-th row are those from cuts[k] to cuts[k + 1]. A long text is a run of its own."""
    held = []
    for row, data, offsets, more in text_pieces(column, piece_bytes):
        hashes, begins = word_hashes(data, offsets[:-1], separators)
        if more or held:
            held.append(hashes)
            if not more:
                hashes = np.concatenate(held)
                held = []
                yield row, hashes, np.array([0, len(hashes)])
            continue
        yield row, hashes, np.searchsorted(begins, offsets)


def text_words(column, piece_bytes: int = PIECE_BYTES):
    """Yields (row, word hashes) for every row of an Arrow string column, empty for null."""
    held = []
    for row, data, offsets, more in text_pieces(column, piece_bytes):
        hashes, begins = word_hashes(data, offsets[:-1])
        if more or held:
            held.append(hashes)
            if not more:
                yield row, np.concatenate(held)
                held = []
            continue
        cuts = np.searchsorted(begins, offsets)
        for k in range(len(offsets) - 1):
            yield row + k, hashes[cuts[k] : cuts[k + 1]]
