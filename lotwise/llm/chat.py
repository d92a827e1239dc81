"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold the same conversation several times, each snapshot a few turns longer. A turn
hash is added up over the turns of a conversation, so every turn ends a prefix with a rolling hash
of all rows so far (two independent 64-bit hashes, summed). A conversation whose whole hash is the
prefix hash of a longer one is dropped by an anti-join; of equal conversations the one with the least
conv_id stays. What remains is rendered with a template.

Long conversations are handled in parts of PART_TURNS turn numbers, part = floor(turn / PART_TURNS):
prefix sums run inside parts and over part totals, and turns are deduplicated, ordered and rendered part
by part. A conversation is one row whatever its turn numbers are, its rendered parts joined in order; only
that last step has all of a conversation's text in one task. DataFrame functions only.

Results for odd rows: rows of a conversation with equal turn, role and text are one; rows that share
a turn number stand in order of role and text, nulls first; a null turn stands just before turn 0; a null role renders as ``unknown``, a null text as empty; null is a conv_id of
its own; an empty table gives an empty result; columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

PART_TURNS = 1024
BROADCAST_CONVERSATIONS = 1_000_000
#: Template of a turn, with {role} and {text}.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
#: The place of a turn: null as 0, but before the turn 0 that has a number.
PLACE = ["turn", "numbered"]


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, numbered, role, text, part) of every row."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    rows = turns.select("conv_id", turn.alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text")
    return rows.withColumn("part", part_of(F.col("turn")))


def part_of(turn: Column) -> Column:
    """floor(turn / PART_TURNS), exactly for any long."""
    return F.floor((turn - F.pmod(turn, F.lit(PART_TURNS))) / PART_TURNS).cast("long") if PART_TURNS > 1 else turn


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turn, numbered, a, b, rows): hash sums of the rows at each place."""
    role, text = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("role", "text"))
    key = ["conv_id", "part", *PLACE]
    rows = placed(turns).select(*key, F.xxhash64(*PLACE, role, text).alias("a"), F.xxhash64(F.lit("second"), *PLACE, text, role).alias("b")).distinct()
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return rows.groupBy(key).agg(total("a"), total("b"), F.count(F.lit(1)).alias("rows"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, numbered, a, b, rows, last): rolling sums up to each place; last on the last one."""
    rows = stored(hashed(turns), "turns")
    sums = ["a", "b", "rows"]
    parts = rows.groupBy("conv_id", "part").agg(*(F.sum(c).alias(f"{c}_part") for c in sums))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", *(F.coalesce(F.sum(f"{c}_part").over(before), F.lit(0)).alias(f"{c}_before") for c in sums), F.max("part").over(behind).alias("last_part"))
    parts = stored(parts.withColumnRenamed("conv_id", "conv").withColumnRenamed("part", "p"), "parts")
    inside = Window.partitionBy("conv_id", "part").orderBy(*PLACE)
    rolled = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("p")))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    last = (F.col("part") == F.col("last_part")) & F.lead("turn").over(inside).isNull()
    return rolled.select("conv_id", *PLACE, *((F.col(f"{c}_before") + F.sum(c).over(so_far)).alias(c) for c in sums), last.alias("last"))


def collapsed(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one and the first of their equals,
    as (conv_id, kept)."""
    rows = stored(prefixes(turns), "prefixes")
    key = [*PLACE, "a", "b", "rows"]
    whole = rows.where("last").groupBy(key).agg(F.min("conv_id").alias("conv_id"))
    kept = stored(whole.join(rows.where("not last").select(key).distinct(), key, "left_anti").select("conv_id"), "kept")
    all_ids = rows.where("last").select("conv_id")
    mark = kept.select(F.col("conv_id").alias("conv"), F.lit(True).alias("kept"))
    return all_ids.join(mark, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def render(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, text) of the maximal conversations."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    gone = stored(collapsed(turns).where(~F.col("kept")).select(F.col("conv_id").alias("gone")), "gone")
    gone = broadcast_if_small(gone, BROADCAST_CONVERSATIONS)
    rows = placed(turns).join(gone, F.col("conv_id").eqNullSafe(F.col("gone")), "left_anti")
    said = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct(*PLACE, "role", "text"))).alias("said"))
    line = lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("unknown")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(tail))
    parts = said.select("conv_id", F.size("said").alias("turns"), F.struct("part", F.array_join(F.transform("said", line), "").alias("text")).alias("rendered"))
    whole = parts.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.array_sort(F.collect_list("rendered")).alias("rendered"))
    return whole.select("conv_id", "n_turns", F.array_join("rendered.text", "").alias("text"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, turn IS NOT NULL AS numbered, role, text FROM conversations),
o AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn, numbered) AS place FROM t),
p AS (SELECT conv_id, place, list({'t': turn, 'n': numbered, 'r': role, 'x': text} ORDER BY turn, numbered, role, text) OVER (PARTITION BY conv_id ORDER BY place RANGE UNBOUNDED PRECEDING) AS said,
  max(place) OVER (PARTITION BY conv_id) AS last FROM o),
d AS (SELECT DISTINCT conv_id, place, last, md5(CAST(list_sort(said) AS VARCHAR)) AS h FROM p),
k AS (SELECT min(conv_id) AS conv_id FROM d WHERE place = last AND h NOT IN (SELECT h FROM d WHERE place < last) GROUP BY h)
SELECT t.conv_id, count(*) AS n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, numbered, role NULLS FIRST, text NULLS FIRST) AS text
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id
"""
