"""Correlation of price levels, aligned by position or by date, among all symbols or those of a portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.numeric import ratio
from lotwise.sources.storage import stored

WORD = 64


def positions(bars: DataFrame) -> DataFrame:
    """(pos, symbol, close): bars numbered from the oldest; symbols with a single bar are left out. Stored."""
    series = Window.partitionBy("symbol")
    rows = bars.select("symbol", "close", (F.row_number().over(series.orderBy("date")) - 1).alias("pos"), F.count(F.lit(1)).over(series).alias("bars")).where(F.col("bars") > 1)
    return stored(rows.select("pos", "symbol", "close"), "positions")


def align_by_position(bars: DataFrame) -> DataFrame:
    """(pos, symbol, close): the n-th oldest bars of all symbols side by side. Symbols with a single bar are
    left out, then positions at which any of the rest has no close."""
    rows = positions(bars)
    symbols = rows.where(F.col("pos") == 0).count()  # every symbol has a first bar
    full = rows.groupBy("pos").agg(F.count("close").alias("closes")).where(F.col("closes") == symbols)
    return rows.join(full.select("pos"), "pos")


def _moments() -> list[Column]:
    return [F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.count(F.lit(1)).alias("n")]


def _mirrored(stats: DataFrame, *keys: str) -> DataFrame:
    """(*keys, symbol_a, symbol_b, corr) of pairs with a <= b and of their mirror images."""
    pair = lambda x, y: F.struct(F.col(x).alias("symbol_a"), F.col(y).alias("symbol_b"))
    both = F.when(F.col("symbol_a") < F.col("symbol_b"), F.array(pair("symbol_a", "symbol_b"), pair("symbol_b", "symbol_a"))).otherwise(F.array(pair("symbol_a", "symbol_b")))
    return stats.select(*keys, "corr", F.explode(both).alias("p")).select(*keys, "p.symbol_a", "p.symbol_b", "corr")


def correlate(aligned: DataFrame, on: str) -> DataFrame:
    """(symbol_a, symbol_b, corr) of all pairs with at least two common rows; NULL for a constant
    series. The aligned rows are stored, pairs with a <= b are computed and then mirrored."""
    rows = stored(aligned.where(F.col("close").isNotNull()).select(on, "symbol", "close"), "aligned")
    a = rows.select(on, F.col("symbol").alias("symbol_a"), F.col("close").alias("a"))
    b = rows.select(on, F.col("symbol").alias("symbol_b"), F.col("close").alias("b"))
    stats = a.join(b, on).where(F.col("symbol_a") <= F.col("symbol_b")).groupBy("symbol_a", "symbol_b").agg(*_moments())
    return _mirrored(stats.where(F.col("n") >= 2).withColumn("corr", ratio(F.col("c"), F.col("sa") * F.col("sb"))))


def masks(held: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions at which all symbols of a portfolio have a close, as bitmaps: (portfolio_id, symbol, mask),
    and (mask, words) of the distinct bitmaps with at least two positions; a bitmap is an ordered array
    of its 64-bit words that are not 0. Portfolios bring their symbols' bitmaps, never their bars."""
    symbols = rows.where(F.col("pos") == 0).select("symbol")
    held = stored(held.select("portfolio_id", "symbol").distinct().join(symbols, "symbol"), "held")
    bit = F.expr(f"shiftleft(1L, CAST(pos % {WORD} AS INT))")
    words = rows.where(F.col("close").isNotNull()).groupBy("symbol", F.expr(f"CAST(pos div {WORD} AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    count = held.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("symbols"))
    common = held.join(words, "symbol").groupBy("portfolio_id", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("having"))
    common = common.join(count, "portfolio_id").where((F.col("having") == F.col("symbols")) & (F.col("bits") != 0))
    whole = common.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).alias("n"))
    whole = stored(whole.where(F.col("n") >= 2).select("portfolio_id", "words"), "portfolio_masks")
    distinct = stored(whole.select("words").distinct().withColumn("mask", F.monotonically_increasing_id()), "masks")
    return held.join(whole.join(distinct, "words").select("portfolio_id", "mask"), "portfolio_id"), distinct


def correlate_held(held: DataFrame, bars: DataFrame) -> DataFrame:
    """(portfolio_id, symbol_a, symbol_b, corr) among the symbols that each portfolio of ``held`` (portfolio_id,
    symbol) holds, aligned by position within the portfolio.

    A correlation depends on the pair and on the positions only, so it is computed once for each pair and
    bitmap of positions that occurs, and looked up by the portfolios."""
    rows = positions(bars)
    held, distinct = masks(held, rows)
    held = stored(held, "held_masks")
    a = held.select("portfolio_id", "mask", F.col("symbol").alias("symbol_a"))
    b = held.select("portfolio_id", F.col("symbol").alias("symbol_b"))
    pairs = a.join(b, "portfolio_id").where(F.col("symbol_a") <= F.col("symbol_b"))
    key = ["mask", "symbol_a", "symbol_b"]
    wanted = stored(pairs.select(key).distinct(), "wanted_pairs")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("w.bits"), i) == 1)
    places = distinct.select("mask", F.explode("words").alias("w")).select("mask", F.col("w.word").alias("word"), F.explode(set_bits).alias("i")).select("mask", (F.col("word") * WORD + F.col("i")).alias("pos"))
    series = stored(places.join(rows, "pos").join(held.select("mask", "symbol").distinct(), ["mask", "symbol"]).select("mask", "symbol", "pos", "close"), "masked")
    side = lambda x: series.select("mask", "pos", F.col("symbol").alias(f"symbol_{x}"), F.col("close").alias(x))
    stats = wanted.join(side("a"), ["mask", "symbol_a"]).join(side("b"), ["mask", "symbol_b", "pos"]).groupBy(key).agg(*_moments())
    stats = stored(stats.select(*key, ratio(F.col("c"), F.col("sa") * F.col("sb")).alias("corr")), "pair_correlations")
    return _mirrored(pairs.join(stats, key), "portfolio_id")
