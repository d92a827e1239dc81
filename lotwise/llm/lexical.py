"""Ranked lexical search over document FP-trees with branch-and-bound per item.

1. One scan turns every document into its number of terms and a vector of term frequencies, restricted
   to the terms that occur in the items. The vectors are stored; N, L and the document frequencies of
   the items' terms are sums over them.
2. Each task takes its vectors TREE_DOCS at a time and builds an FP-tree: terms in order of falling
   document frequency, one path for each vector, equal beginnings shared. A path is followed in one
   step up to where its documents part, and a node of LEAF_DOCS documents or fewer isn't split further.
   Every node has the largest frequency of each term below it and the smallest m.
3. For each item the tree is searched depth first, children of larger bounds first. A score grows with
   tf and falls with m, so the score of a node's maxima at its least m bounds all documents below; where
   that is under the 20th score found so far (by the task, in any of its trees) the node is left out.
   Documents of the leaves that remain are scored exactly, all in 64-bit integers.
4. The best of all tasks are ranked by a window per item, which keeps only the first ``top`` of each
   partition before it shuffles.

Items are taken in blocks of about BLOCK_TERMS terms, chosen by hash, so what is sent to all tasks and
the width of a tree's maxima are bounded. Terms are told apart by 64-bit hashes.

Results for odd rows: rows without terms are no documents of N and are never returned; rows that repeat
a doc_id are documents each; a null doc_id comes last among equal scores; rows that repeat an item_id, or
have none, are items each, ranked apart under that item_id; an item without terms, or whose terms no
document has, gives no rows; a text of any length is read whole; an empty table gives an empty result;
columns other than the four named are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_TERM, run_words, small_batches, stored

TOP = 20
TREE_DOCS, LEAF_DOCS = 2048, 16
#: Terms, with repeats, of the items that are searched for at once.
BLOCK_TERMS = 1 << 16
#: Bits of the table that says quickly that a term is in no item; a power of 2.
FILTER_BITS = 1 << 20
#: What is used of m = 100 - 25 + (25 n N) div L and (SCALE tf) div (1000 tf + 12 m).
SCALE = 1_000_000_000

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def _vectors(vocabulary):
    """(doc_id, n, terms, counts) of the documents with any term; terms are places in the vocabulary."""

    def run(batches):
        import pyarrow as pa

        known = vocabulary.value
        table = np.zeros(FILTER_BITS, dtype=bool)
        table[known & np.uint64(FILTER_BITS - 1)] = True
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            found = [np.empty((3, 0), np.int64)]
            for row, words, cuts in run_words(batch.column("text"), NOT_TERM):
                n[row : row + len(cuts) - 1] = np.diff(cuts)
                at = np.flatnonzero(table[words & np.uint64(FILTER_BITS - 1)])
                k = np.searchsorted(known, words[at])
                k[k == len(known)] = 0
                right = known[k] == words[at] if len(known) else np.zeros(len(at), bool)
                doc = np.searchsorted(cuts, at[right], side="right") - 1 + row
                key, count = np.unique(doc * len(known) + k[right], return_counts=True)
                found.append(np.stack([key // max(1, len(known)), key % max(1, len(known)), count]))
            doc, term, count = np.concatenate(found, axis=1)
            ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return run


class Tree:
    """An FP-tree over a dense block of term frequencies, a row per document, terms by falling document
    frequency. Nodes are numbered so that children of a node stand in a row."""

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        present = np.packbits(tf > 0, axis=1)
        # documents in the order of their paths: those with the next most frequent term before those without
        order = sorted(range(len(tf)), key=[~int.from_bytes(p.tobytes(), "big") for p in present].__getitem__)
        self.order = np.array(order, dtype=np.int64)
        self.tf, self.m = tf[self.order], m[self.order]
        paths = [np.flatnonzero(row) for row in self.tf]
        #: How many terms the paths of a document and the next have in common.
        self.shared = np.array([self._common(a, b) for a, b in zip(paths, paths[1:])], dtype=np.int64)
        self.first, self.stop, self.children = [0], [len(tf)], []
        node = 0
        while node < len(self.first):
            lo, hi = self.first[node], self.stop[node]
            cuts = self._parting(lo, hi) if hi - lo > LEAF_DOCS else []
            self.children.append((len(self.first), len(self.first) + len(cuts) + 1) if len(cuts) else None)
            if len(cuts):
                edges = [lo, *cuts, hi]
                self.first += edges[:-1]
                self.stop += edges[1:]
            node += 1
        self.maxima = np.zeros((len(self.first), tf.shape[1]), dtype=tf.dtype)
        self.least_m = np.zeros(len(self.first), dtype=np.int64)
        for node in range(len(self.first) - 1, -1, -1):
            below = self.children[node]
            self.maxima[node] = self.maxima[slice(*below)].max(axis=0) if below else self.tf[self.first[node] : self.stop[node]].max(axis=0)
            self.least_m[node] = self.least_m[slice(*below)].min() if below else self.m[self.first[node] : self.stop[node]].min()

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def _parting(self, lo: int, hi: int) -> list[int]:
        """Where the paths of documents lo .. hi - 1 part, behind all that they share. Neighbouring
        branches of few documents are one node, up to LEAF_DOCS."""
        inner = self.shared[lo : hi - 1]
        parted = (np.flatnonzero(inner == inner.min()) + lo + 1).tolist()
        cuts, start = [], lo
        for cut, after in zip(parted, [*parted[1:], hi]):
            if after - start > LEAF_DOCS:
                cuts.append(cut)
                start = cut
        return cuts

    def search(self, terms: np.ndarray, weights: np.ndarray, enough):
        """Calls ``enough(rows, scores)`` with the documents of leaves, best bounds first; it returns the
        least score that still counts, without rows the present one."""
        least, stack = enough(None, None), [(0, None)]
        while stack:
            node, bound = stack.pop()
            if bound is not None and bound < least:
                continue
            below = self.children[node]
            if below is None:
                lo, hi = self.first[node], self.stop[node]
                least = enough(self.order[lo:hi], scores(self.tf[lo:hi, terms], self.m[lo:hi], weights))
                continue
            bounds = scores(self.maxima[slice(*below)][:, terms], self.least_m[slice(*below)], weights)
            for k in np.argsort(bounds, kind="stable"):  # the best is on top of the stack
                if bounds[k] >= least:
                    stack.append((below[0] + int(k), int(bounds[k])))


def scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of rows of term frequencies."""
    tf = tf.astype(np.int64)
    return (SCALE * tf // np.maximum(1, 1000 * tf + 12 * m[:, None])) @ weights


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:  # past 64 bits
        return np.array([75 + 25 * int(x) * docs // words for x in n], dtype=np.int64)
    return 75 + 25 * n * docs // words


class Best:
    """The ``top`` best documents of an item so far."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc, self.null = (np.empty(0, np.int64) for _ in range(3))

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) >= self.top else 1

    def take(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least()
        if not keep.any():
            return
        score, doc, null = (np.r_[a, b[keep]] for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def _searched(block, top: int):
    def run(batches):
        import pyarrow as pa

        numbers, items, column, docs, words = block.value
        best = [Best(top) for _ in items]
        for ids, null, n, tf in _dense(batches, column):
            tree = Tree(tf, lengths(n, docs, words))
            for (terms, weights), found in zip(items, best):

                def enough(rows, got, found=found):
                    if rows is not None:
                        found.take(got, ids[rows], null[rows])
                    return found.least()

                if len(terms):
                    tree.search(terms, weights, enough)
        for k in range(0, len(best), 256):
            part = best[k : k + 256]
            item = np.repeat(np.array(numbers[k : k + len(part)], dtype=np.int64), [len(b.score) for b in part])
            doc = pa.array(np.concatenate([b.doc for b in part]), mask=np.concatenate([b.null for b in part]).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(np.concatenate([b.score for b in part]))], ["number", "doc_id", "score"])

    return run


def _dense(batches, column: np.ndarray):
    """(ids, null ids, n, dense frequencies) of TREE_DOCS documents at a time; ``column`` has the place of
    each term in the trees."""
    import pyarrow as pa

    held, rows, width = [], 0, int(column.max(initial=-1)) + 1

    def block():
        whole = pa.Table.from_batches(held).combine_chunks()
        lists, counts = whole.column("terms").combine_chunks(), whole.column("counts").combine_chunks()
        tf = np.zeros((len(whole), width), np.int32)
        tf[np.repeat(np.arange(len(whole)), lists.value_lengths().to_numpy()), column[lists.flatten().to_numpy()]] = counts.flatten().to_numpy()
        ids = whole.column("doc_id").combine_chunks()
        return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), whole.column("n").to_numpy(), tf

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, TREE_DOCS - rows)
            at += part.num_rows
            rows += part.num_rows
            held.append(part)
            if rows == TREE_DOCS:
                yield block()
                held, rows = [], 0
    if held and rows:
        yield block()


def block_items(items: DataFrame, blocks: int, number: int) -> tuple[list, list[np.ndarray]]:
    """Numbers and term hashes of the items of a block: bounded by the number of blocks."""
    own = items.where(F.pmod("number", F.lit(blocks)) == number).toArrow()
    words: list = [None] * own.num_rows
    if own.num_rows:
        for row, hashes, cuts in run_words(own.column("text"), NOT_TERM):
            for k in range(len(cuts) - 1):
                words[row + k] = hashes[cuts[k] : cuts[k + 1]]
    return own.column("number").to_pylist(), words


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stored(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 4 / block_terms))
    found = None
    for number in range(blocks):
        numbers, words = block_items(items.select("number", "text"), blocks, number)
        known = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        vectors = stored(texts.mapInArrow(_vectors(spark.sparkContext.broadcast(known)), VECTORS), "vectors")
        n_docs, n_words = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = {r.term: r.n for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        # columns of a tree: terms that occur, the most frequent first
        order = sorted(df, key=lambda t: (-df[t], t))
        column = np.full(len(known), -1)
        column[order] = np.arange(len(order))
        asked = []
        for w in words:
            term, times = np.unique(column[np.searchsorted(known, w)], return_counts=True)
            term, times = term[term >= 0], times[term >= 0]
            asked.append((term, times * np.array([weight(n_docs, df[order[t]]) for t in term], dtype=np.int64)))
        block = spark.sparkContext.broadcast((numbers, asked, column, n_docs, n_words or 1))
        rows = vectors.mapInArrow(_searched(block, top), "number long, doc_id long, score long")
        found = rows if found is None else found.unionByName(rows)
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT k, item_id, t, count(*) AS times FROM i GROUP BY ALL),
g AS (SELECT count(*) AS n_all, sum(len(w)) AS l_all FROM d WHERE len(w) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY t, n_all),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_all) // CAST(l_all AS BIGINT) AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT k, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW best AS (PARTITION BY k ORDER BY score DESC, doc_id) QUALIFY rank <= 20
"""
