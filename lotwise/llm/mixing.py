"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its doc_id and text. Per source, document sizes are summed by the top
hash bits; the cumulative histogram names the bucket in which the source's budget runs out, and only
that bucket is split again by the next bits, three levels deep. The thresholds, one row per source,
then select documents with a plain filter: nothing is sorted and no document list is gathered.

A target above its source's size repeats documents: all of them floor(target/size) times and the
ones under the threshold once more. Targets stop at CAP times the source, so no document exceeds
CAP times its size. DataFrame functions only; reruns give the same mix.

Results for odd rows: a null text has size 0 and is taken 0 words; null is a source of its own, the
last one; rows that repeat a doc_id are selected each by its own text (those that repeat the text too are
selected alike); an empty table gives an empty result; columns other than the three named are not read
and may have any names. The per-source arithmetic (rank by name, capping)
is a window over one row per source, whatever the number of documents.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, word_count

#: A source may be repeated up to this many times.
CAP = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
LEVELS, LEVEL_BITS, HASH_BITS = 3, 10, 60
#: Up to this many sources their thresholds are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of md5(doc_id:text)."""
    known = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target): weighted shares of all sizes, capped at CAP times the source.

    Capping and resharing until no target is above its cap is the water level at which the shares
    sum to the total: sources are capped in order of cap/weight as long as that ratio is not above
    the level left by those before."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    kinds = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    kinds = kinds.select("source", "source_size", weight.alias("w"), (F.col("source_size") * CAP).alias("cap"))
    order = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before_cap, before_w = F.coalesce(F.sum("cap").over(order), F.lit(0)), F.coalesce(F.sum("w").over(order), F.lit(0))
    total, all_w = F.sum("source_size").over(everything), F.sum("w").over(everything)
    kinds = kinds.select("*", (F.col("cap").cast("double") * (all_w - before_w) <= F.col("w") * (total - before_cap)).alias("capped"), total.alias("total"), all_w.alias("all_w"))
    free = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    level = F.try_divide((F.col("total") - free("cap")).cast("double"), (F.col("all_w") - free("w")).cast("double"))
    return kinds.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def prefix(h: Column, level: int) -> Column:
    return F.shiftright(h, HASH_BITS - LEVEL_BITS * level)


def thresholds(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source, source_size, target, times, bar, taking): each source takes all its documents
    ``times`` times, and once more those whose 30-bit hash prefix is below ``bar``, or equal to it
    where ``taking`` holds."""
    times = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).cast("long")
    times = F.least(times, F.lit(CAP).cast("long"))
    state = kinds.select("*", times.alias("times"), (F.col("target") - times * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("bar"))
    for level in range(1, LEVELS + 1):
        held = broadcast_if_small(stored(state, f"mix{level}"), BROADCAST_SOURCES)
        inside = rows.join(held.select(F.col("source").alias("s"), "bar"), F.col("source").eqNullSafe(F.col("s")) & (prefix(F.col("h"), level - 1) == F.col("bar")))
        cells = inside.groupBy("s", prefix(F.col("h"), level).alias("cell")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select("s", "cell", "words", (F.sum("words").over(running) - F.col("words")).alias("below"))
        cells = cells.join(held.select(F.col("source").alias("t"), "left"), F.col("s").eqNullSafe(F.col("t"))).where(F.col("below") <= F.col("left"))
        edge = cells.groupBy("s").agg(F.max(F.struct("cell", "below", "words")).alias("e"))
        state = held.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "source_size",
            "target",
            "times",
            (F.col("left") - F.coalesce(F.col("e.below"), F.lit(0))).alias("left"),
            F.coalesce(F.col("e.cell"), F.shiftleft(F.col("bar"), LEVEL_BITS)).alias("bar"),
            (F.coalesce(F.col("e.words"), F.lit(0)) / F.lit(2.0)).alias("half"),
        )
    return state.withColumn("taking", (F.col("left") > F.col("half")) & (F.col("times") < CAP)).drop("left", "half")


def plan_of(rows: DataFrame) -> DataFrame:
    """The thresholds of all sources, with names that no document column has."""
    kinds = stored(targets(rows), "targets")
    plan = broadcast_if_small(stored(thresholds(rows, kinds), "bars"), BROADCAST_SOURCES)
    return plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns))


def copies(h: Column) -> Column:
    """How often a document with this hash is taken, beside the columns of ``plan_of``."""
    cell = prefix(h, LEVELS)
    once_more = (F.col("__times") < CAP) & ((cell < F.col("__bar")) | ((cell == F.col("__bar")) & F.col("__taking")))
    return F.col("__times") + once_more.cast("long")


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = stored(sized(docs), "sized")
    return rows.join(plan_of(rows), F.col("source").eqNullSafe(F.col("__source")), "left").select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * copies(F.col("h"))).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken. Documents without
    words cost nothing and stay once. The thresholds are applied to the rows as they are read, so
    no text is shuffled while they can be broadcast."""
    plan = plan_of(stored(sized(docs), "sized"))
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = {name: F.col(c) for name, c in zip(docs.columns, own)}
    rows = docs.toDF(*own).select(*own, word_count(at["text"]).alias("size"), row_hash(at["doc_id"], at["text"]).alias("h"))
    times = F.when(F.col("size") > 0, copies(F.col("h"))).otherwise(1).cast("int")
    rows = rows.join(plan, at["source"].eqNullSafe(F.col("__source"))).withColumn("times", times).where(F.col("times") > 0)
    return rows.select(*own, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*own).toDF(*docs.columns)


def _level_sql(rows: str, state: str, level: int) -> str:
    shift, up = 1 << (HASH_BITS - LEVEL_BITS * level), 1 << (HASH_BITS - LEVEL_BITS * (level - 1))
    return f"""
cells{level} AS (SELECT r.source, r.h // {shift} AS cell, sum(r.size) AS words FROM {rows} r JOIN {state} k
  ON r.source IS NOT DISTINCT FROM k.source AND r.h // {up} = k.bar GROUP BY 1, 2),
runs{level} AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell) - words AS below FROM cells{level}),
edge{level} AS (SELECT c.source, max(cell) AS cell FROM runs{level} c JOIN {state} k ON c.source IS NOT DISTINCT FROM k.source
  WHERE c.below <= k.lft GROUP BY 1),
state{level} AS (SELECT k.source, k.source_size, k.target, k.times, k.lft - coalesce(c.below, 0) AS lft,
  coalesce(e.cell, k.bar * {1 << LEVEL_BITS}) AS bar, coalesce(c.words, 0) / 2.0 AS half FROM {state} k
  LEFT JOIN edge{level} e ON e.source IS NOT DISTINCT FROM k.source
  LEFT JOIN runs{level} c ON c.source IS NOT DISTINCT FROM k.source AND c.cell = e.cell)"""


def oracle() -> str:
    space = r"[^\x20\x09-\x0D]+"
    levels = ",".join(_level_sql("r", f"state{n - 1}", n) for n in range(1, LEVELS + 1))
    cell = f"h // {1 << (HASH_BITS - LEVEL_BITS * LEVELS)}"
    return f"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{space}')) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, {CAP} * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER q, 0) AS bc, coalesce(sum(w) OVER q, 0) AS bw, sum(source_size) OVER () AS total,
  sum(w) OVER () AS allw FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, cap * (allw - bw) <= w * (total - bc) AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
  CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) / CAST(allw - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS DOUBLE) * w
  END AS target FROM p),
state0 AS (SELECT *, least(CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END, {CAP}) AS times,
  target - least(CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END, {CAP}) * source_size AS lft,
  0 AS bar FROM t),{levels}
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, k.source_size, k.target,
  CAST(r.size * (k.times + CASE WHEN k.times < {CAP} AND ({cell} < k.bar OR ({cell} = k.bar AND k.lft > k.half)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN state{LEVELS} k ON r.source IS NOT DISTINCT FROM k.source
"""


