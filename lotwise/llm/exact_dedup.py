"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass (Spark's ``freqItems``) names every digest that could hold more than ``support``
of all rows. Those candidates are counted exactly; the ones that do hold that share, at most 1/support,
are the winners and are broadcast: their rows are resolved map-side. All other digests, none of them
frequent, go through the ordinary shuffle: counts are summed before it, and rows meet them in a join of
stored tables, which AQE can split. DataFrame functions only.

Results for odd rows: null and empty texts are equal to each other; a null doc_id never wins against
a number; rows that repeat a doc_id are judged each by its own text, and all rows with the winning
doc_id and text count as kept (``drop_copies`` leaves one of them); an empty table gives an empty
result; columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, keyed, stored, without

#: Digests above this share of the rows are split off; 1/SUPPORT bounds the broadcast.
SUPPORT = 0.001


def digests(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, probe, ...): SHA-256 of the normalised text, a 64-bit key for counting, and the
    columns ``more``."""
    normal = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), *more, F.unhex(F.sha2(normal, 256)).alias("digest")).withColumn("probe", F.xxhash64("digest"))


def winners(rows: DataFrame, groups, support: float = SUPPORT) -> DataFrame:
    """``groups`` of the digests that hold more than ``support`` of all rows: found by Misra-Gries,
    verified by their counts."""
    found = rows.stat.freqItems(["probe"], support).first()
    candidates = [k for k in (found[0] if found and found[0] else []) if k is not None]
    if len(candidates) > 2 / support:
        raise ValueError("more frequent digests than Misra-Gries counters")
    of = groups(rows.where(F.col("probe").isin(candidates) if candidates else F.lit(False)))
    return of.where(F.col("group_size") > support * rows.count())


def classed(rows: DataFrame, *tie: str, support: float = SUPPORT) -> DataFrame:
    """``rows`` with group_size and keep, the (doc_id, *tie) of the row of their digest that stays."""

    keep = F.max(F.struct("doc_id", *tie)) if tie else F.struct(F.max("doc_id").alias("doc_id"))  # a plain maximum needs no sort

    def groups(some: DataFrame) -> DataFrame:
        return some.groupBy("digest").agg(keep.alias("keep"), F.count(F.lit(1)).alias("group_size"))

    heavy = F.broadcast(stored(winners(rows, groups, support), "winners"))
    rest = rows.join(heavy, "digest", "left_anti")
    return rows.join(heavy, "digest").unionByName(rest.join(groups(rest), "digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(digests(docs, id_col=id_col, text_col=text_col), "digests")
    return classed(rows, support=support).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of every text, that of the largest doc_id, all columns."""
    rows = stored(digests(keyed(docs), *KEY), "digests")
    copies = stored(classed(rows, *KEY).where(F.col("group_size") > 1).select(*KEY, "keep"), "copies")
    winning = (F.col("key1") == F.col("keep.key1")) & (F.col("key2") == F.col("keep.key2"))
    again = copies.where(winning).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return without(docs, copies.where(~winning), again)
