"""Connected components by alternating large-star and small-star steps, all as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over (u, v) edges with u > v.

    Large: every neighbour above a node links to the least node around it. Small: so does every
    neighbour at or below it. The minima are stored first: the join then reads two plain scans, and
    AQE can split a hub that very many edges share."""
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")), "least")
    rows = around.join(least, "u")
    if small:
        pairs = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        pairs = rows.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    out = stored(pairs.where(F.col("u") != F.col("v")).distinct(), "star")
    discard(least)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its least node."""
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        large = _star(now, small=False)
        after = _star(large, small=True)
        discard(now, large)
        now = after
        # done when every node hangs from its root: as many edges as nodes above, and no root hangs
        new = now.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
