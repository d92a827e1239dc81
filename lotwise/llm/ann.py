"""Nearest neighbours by inner product from low-dimensional stable projections in kd-trees.

Largest inner product becomes smallest distance by one more component: a vector x gets
sqrt(M^2 - |x|^2), where M is the greatest norm, a query gets 0. A Gaussian (2-stable) matrix projects
these to DIMS dimensions, where squared distances over the true ones follow a chi-square law.

Index. A kd-tree over the projections of a sample of SAMPLE_ROWS rows cuts the space into at most
MAX_CELLS cells; every row is indexed in its cell, and a cell is cut by hash into blocks of about
BLOCK_ROWS. Each block has a kd-tree of its own in the task that searches it.

Search. A query first visits its own cell. Inside a block it takes leaves in order of projected
distance and verifies their vectors with the exact measure, until the test holds: a vector nearer
than the k-th found so far would be projected this far with a chance below 1 - SURE. What the first
visit finds bounds the second, to every other cell that the same test does not rule out. Queries
and blocks meet in pieces of bounded size: a block is sent out once for each piece of its queries, and
pieces grow up to QUERY_ROWS while there are enough of them for all cores.

Matrix products only tell which rows can be among the best, with room for their rounding. Scores are
summed in double precision in one order, so equal vectors tie exactly; ties go to the smaller id. Results for odd rows: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most common one; rows that repeat an
id are candidates each, but not for the query of their id; a null id takes no part; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

DIMS = 8
#: Chance with which a neighbour at the distance of the k-th found is met before the search stops.
SURE = 0.98
SAMPLE_ROWS, MAX_CELLS = 20_000, 1024
CELL_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 16_384, 256
#: Queries that meet a block in one task, at least and at most (if there are so many), and at once in it.
FEWEST_ROWS, QUERY_ROWS, TOGETHER = 1024, 16_384, 1024
#: Pieces for each core.
PIECES = 4
BROADCAST_BLOCKS = 200_000


def chi_square_cdf(x: float, dims: int = DIMS) -> float:
    """For an even number of dimensions."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dims // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < p else (low, mid)
    return high


STOP = chi_square_quantile(SURE)


def projection(length: int) -> np.ndarray:
    return np.random.default_rng(length).standard_normal((length + 1, DIMS))


def projected(vectors: np.ndarray, most: float | None) -> np.ndarray:
    """Projections of vectors, or of queries if ``most``, the greatest squared norm, is None."""
    matrix = projection(vectors.shape[1])
    out = vectors @ matrix[:-1]
    if most is not None:
        rest = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", vectors, vectors), 0))
        out += rest[:, None] * matrix[-1]
    return out


def split_tree(points: np.ndarray, leaf_rows: int, max_leaves: int | None = None) -> tuple[list, list[np.ndarray]]:
    """A kd-tree as nodes (axis, threshold, left, right) or (-1, leaf, 0, 0), and the rows of leaves.

    The widest axis is cut at its middle row; points that are all equal are cut anywhere."""
    nodes, leaves, todo = [], [], [(np.arange(len(points)), -1, False, max_leaves or len(points) + 1)]
    while todo:
        rows, parent, right, budget = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if right else 2] = me
        if len(rows) <= leaf_rows or budget < 2:
            nodes.append([-1, len(leaves), 0, 0])
            leaves.append(rows)
            continue
        here = points[rows]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        order = rows[np.argsort(here[:, axis], kind="stable")]
        half = len(order) // 2
        nodes.append([axis, float(points[order[half], axis]), 0, 0])
        todo += [(order[half:], me, True, budget - budget // 2), (order[:half], me, False, budget // 2)]
    return nodes, leaves


def descend(nodes: list, points: np.ndarray) -> np.ndarray:
    """Leaf of each point; a point at the threshold goes right."""
    table = np.array([n[:1] + n[2:] for n in nodes], dtype=np.int64)
    value = np.array([n[1] for n in nodes])
    at = np.zeros(len(points), dtype=np.int64)
    while True:
        axis = table[at, 0]
        inner = axis >= 0
        if not inner.any():
            return value[at].astype(np.int64)
        right = points[np.arange(len(points)), np.maximum(axis, 0)] >= value[at]
        at = np.where(inner, np.where(right, table[at, 2], table[at, 1]), at)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - points[:, d, None], points[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search_block(ids, vectors, query_ids, queries, bound, most: float, k: int):
    """The best ``k`` of a block for each query: (row of query, id, score). ``bound`` holds the squared
    distance of the k-th neighbour that each query has already, or infinity."""
    place = projected(vectors, most)
    _, leaves = split_tree(place, LEAF_ROWS)
    low = np.array([place[r].min(axis=0) for r in leaves])
    high = np.array([place[r].max(axis=0) for r in leaves])
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    for a in range(0, len(queries), TOGETHER):
        part = slice(a, a + TOGETHER)
        _visit_leaves(ids, vectors, leaves, low, high, query_ids[part], queries[part], bound[part], most, best[part], best_id[part])
    row, col = np.nonzero(best > -np.inf)
    return row, best_id[row, col], best[row, col]


def _visit_leaves(ids, vectors, leaves, low, high, query_ids, queries, bound, most, best, best_id) -> None:
    """Brings the best scores and ids, a row for each query, up to date with a block's leaves."""
    far = box_distance(projected(queries, None), low, high)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, axis=1)
    norm = np.einsum("ij,ij->i", queries, queries)
    room = 1e-9 * np.sqrt(norm * most)  # far above the rounding of a product
    limit, k = bound.copy(), best.shape[1]
    for step in range(len(leaves)):
        active = np.flatnonzero(far[:, step] <= STOP * limit)
        if not len(active):
            break  # later leaves are farther still
        leaf_of = order[active, step]
        for leaf in np.unique(leaf_of):
            q, rows = active[leaf_of == leaf], leaves[leaf]
            near = queries[q] @ vectors[rows].T
            near[query_ids[q][:, None] == ids[rows][None, :]] = -np.inf
            least = best[q, -1]
            if len(rows) > k:
                least = np.maximum(least, np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k])
            row, col = np.nonzero((near >= (least - room[q])[:, None]) & (near > -np.inf))
            score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", queries[q[row[i : i + 8192]]], vectors[rows[col[i : i + 8192]]]) for i in range(0, len(row), 8192))])
            found = ids[rows[col]]
            worst, worst_id = best[q[row], -1], best_id[q[row], -1]
            new = (score > worst) | ((score == worst) & (found < worst_id))
            row, score, found = row[new], score[new], found[new]
            changed, at = np.unique(row, return_inverse=True)
            mine = q[changed]
            of = np.concatenate([np.repeat(np.arange(len(mine)), k), at])
            all_score, all_id = np.concatenate([best[mine].ravel(), score]), np.concatenate([best_id[mine].ravel(), found])
            rank = np.lexsort((all_id, -all_score, of))
            take = rank[np.searchsorted(of[rank], np.arange(len(mine)))[:, None] + np.arange(k)]
            best[mine], best_id[mine] = all_score[take], all_id[take]
            limit[mine] = np.minimum(bound[mine], np.maximum(norm[mine] + most - 2 * best[mine, -1], 0))


def _searcher(most: float, k: int):
    def run(data, asked):
        import pandas as pd

        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        vectors, queries = (np.stack(x.to_list()).astype(np.float64) for x in (data["vec"], asked["vec"]))
        query_ids = asked["query_id"].to_numpy()
        row, found, score = search_block(data["vec_id"].to_numpy(), vectors, query_ids, queries, asked["bound"].to_numpy(), most, k)
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": found, "score": score})

    return run


def _placer(nodes, most: float):
    def run(batches):
        for batch in batches:
            vectors = np.stack(batch["vec"].to_list()).astype(np.float64) if len(batch) else np.empty((0, 0))
            if len(batch):
                place = projected(vectors, most)
                batch["cell"] = descend(nodes, place).astype(np.int32)
                batch["place"] = list(place)
                yield batch[["vec_id", "vec", "cell", "place"]]

    return run


def _router(low, high, cells):
    """Other cells than a query's own that the stopping test does not rule out."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            if not len(batch):
                continue
            queries = np.stack(batch["vec"].to_list()).astype(np.float64)
            near = box_distance(projected(queries, None), low, high) <= STOP * batch["bound"].to_numpy()[:, None]
            near &= batch["cell"].to_numpy()[:, None] != cells[None, :]
            row, col = np.nonzero(near)
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[row], "vec": batch["vec"].to_numpy()[row], "bound": batch["bound"].to_numpy()[row], "cell": cells[col].astype(np.int32)})

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0]["length"] if lengths else 0))


class Index:
    """The cells of a table of vectors, ready for ``search``."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding"):
        rows = usable(vectors, id_col, vec_col)
        norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        self.rows, most = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
        self.most = float(most or 0.0) * (1 + 1e-12)
        share = min(1.0, SAMPLE_ROWS / max(self.rows, 1))
        # drawn by row: an id that very many rows have doesn't bring them all; rows that are equal come together, so one of them
        drawn = rows.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < share * (1 << 30)).select("vec_id", "vec").distinct().select("vec").toPandas()["vec"]
        wanted = min(MAX_CELLS, max(1, self.rows // CELL_ROWS))
        nodes = [[-1, 0, 0, 0]]
        if wanted > 1 and len(drawn):
            nodes, _ = split_tree(projected(np.stack(drawn.to_list()), self.most), 1, wanted)
        placed = stored(rows.mapInPandas(_placer(nodes, self.most), "vec_id long, vec array<double>, cell int, place array<double>"), "placed_vectors")
        ends = [f(F.get("place", F.lit(d))).alias(f"{n}{d}") for d in range(DIMS) for n, f in (("low", F.min), ("high", F.max))]
        boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()
        self.cells = np.array([b["cell"] for b in boxes], dtype=np.int64)
        self.low, self.high = (np.array([[b[f"{n}{d}"] for d in range(DIMS)] for b in boxes]).reshape(-1, DIMS) for n in ("low", "high"))
        cuts = {int(b["cell"]): math.ceil(b["n"] / BLOCK_ROWS) for b in boxes}
        self.cuts = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("cell")) if cuts else F.lit(1)
        self.placed = placed.select("vec_id", "vec", "cell")

    def _meet(self, asked: DataFrame, k: int) -> DataFrame:
        """Best ``k`` per query and block, for queries (query_id, vec, bound, cell)."""
        asked = stored(asked.withColumn("cut", F.explode(F.sequence(F.lit(0), self.cuts - 1))), "asked")
        cores = asked.sparkSession.sparkContext.defaultParallelism
        together = min(QUERY_ROWS, max(FEWEST_ROWS, math.ceil(asked.count() / (PIECES * cores))))
        pieces = asked.groupBy("cell", "cut").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("pieces"))
        pieces = broadcast_if_small(stored(pieces, "pieces"), BROADCAST_BLOCKS)
        asked = asked.join(pieces, ["cell", "cut"]).withColumn("piece", F.pmod(F.xxhash64("query_id"), F.col("pieces")).cast("int"))
        data = self.placed.withColumn("cut", F.pmod(F.xxhash64("vec_id"), self.cuts).cast("int"))
        data = data.join(pieces, ["cell", "cut"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        key = ["cell", "cut", "piece"]
        met = data.select(*key, "vec_id", "vec").groupBy(key).cogroup(asked.select(*key, "query_id", "vec", "bound").groupBy(key))
        return met.applyInPandas(_searcher(self.most, k), "query_id long, vec_id long, score double")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score): the ``k`` nearest of each row of ``asked``, a selection of
        the indexed rows (vec_id, vec, cell); a row is no neighbour of itself."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asked = asked.select(F.col("vec_id").alias("query_id"), "vec", "cell")
        first = stored(top(self._meet(asked.withColumn("bound", F.lit(float("inf"))), k)), "first_visit")
        kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        bound = F.when(F.col("kth").isNotNull(), F.greatest(norm + self.most - 2 * F.col("kth"), F.lit(0.0))).otherwise(float("inf"))
        known = asked.join(kth.distinct(), "query_id", "left").select("query_id", "vec", "cell", bound.alias("bound"))
        onward = known.mapInPandas(_router(self.low, self.high, self.cells), "query_id long, vec array<double>, bound double, cell int")
        second = self._meet(onward, k)
        return top(first.drop("rank").unionByName(second)).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``, among all rows."""
    index = Index(vectors, id_col, vec_col)
    return index.search(index.placed.where(F.col("vec_id") % every == 0), k)
