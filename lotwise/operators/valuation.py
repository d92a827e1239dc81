"""Valuing lots and everything that follows from it: summaries, allocation, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.numeric import exact_sum, money, ratio

LOT = ["portfolio_id", "symbol", "shares", "purchase_price", "purchase_date"]


def latest_prices(bars: DataFrame) -> DataFrame:
    """(symbol, price): the close of each symbol's last bar, NULL if that is NULL."""
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))


def value_lots(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Lots with current_price, current_value, gain_loss_dollars, gain_loss_percent; NULL without a
    price. Prices are one row per symbol; Spark broadcasts them while they are small."""
    cost = F.col("shares") * F.col("purchase_price")
    value = F.col("shares") * F.col("price")
    return lots.join(prices, "symbol", "left").select(
        *LOT,
        F.col("price").alias("current_price"),
        value.alias("current_value"),
        (value - cost).alias("gain_loss_dollars"),
        (ratio(value - cost, cost) * 100).alias("gain_loss_percent"),
    )


def totals(valued: DataFrame) -> DataFrame:
    """Unrounded invested and current value and lot count per portfolio. A lot without a price counts
    as invested; a portfolio without any price has current value 0."""
    return valued.groupBy("portfolio_id").agg(
        F.coalesce(F.sum(F.col("shares") * F.col("purchase_price")), F.lit(0.0)).alias("invested"),
        F.coalesce(F.sum("current_value"), F.lit(0.0)).alias("current"),
        F.count(F.lit(1)).alias("number_of_holdings"),
    )


def summarize(valued: DataFrame) -> DataFrame:
    return summary_of(totals(valued))


def summary_of(totals: DataFrame) -> DataFrame:
    """What reports show of (portfolio_id, invested, current, number_of_holdings)."""
    gain = F.col("current") - F.col("invested")
    return totals.select(
        "portfolio_id",
        money(F.col("invested")).alias("total_invested"),
        money(F.col("current")).alias("total_current_value"),
        money(gain).alias("total_gain_loss_dollars"),
        money(F.when(F.col("invested") > 0, ratio(gain, F.col("invested")) * 100).otherwise(0.0)).alias("total_gain_loss_percent"),
        "number_of_holdings",
    )


def allocate(valued: DataFrame, by_symbol: bool = False) -> DataFrame:
    """Share of each lot, or symbol, in its portfolio's value, in percent."""
    rows = valued.groupBy("portfolio_id", "symbol").agg(exact_sum(F.col("current_value")).alias("current_value")) if by_symbol else valued
    whole = valued.groupBy("portfolio_id").agg(F.sum("current_value").alias("whole"))
    return rows.join(whole, "portfolio_id").withColumn("allocation_percent", money(ratio(F.col("current_value"), F.col("whole")) * 100)).drop("whole")


def concentrate(valued: DataFrame) -> DataFrame:
    """Share of each lot in the rounded total, with a band."""
    whole = summarize(valued).select("portfolio_id", "total_current_value")
    percent = ratio(F.col("current_value"), F.col("total_current_value")) * 100
    band = F.when(F.col("percent") > 30, "high").when(F.col("percent") > 20, "medium").otherwise("low")
    return valued.join(whole, "portfolio_id").withColumn("percent", percent).withColumn("band", band)


def _order(best: bool) -> list[Column]:
    first = F.desc_nulls_last("gain_loss_percent") if best else F.asc_nulls_last("gain_loss_percent")
    return [first, *(F.asc(c) for c in LOT[1:])]


def performers(valued: DataFrame, k: int | None, best: bool = True) -> DataFrame:
    """The ``k`` lots of each portfolio with the highest, or lowest, gain in percent (all if None)."""
    ranked = valued.withColumn("rank", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(*_order(best))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def extremes(valued: DataFrame) -> DataFrame:
    """Symbol and gain of the best and the worst lot of each portfolio, in one pass."""
    priced = valued.where(F.col("gain_loss_percent").isNotNull())
    key = F.struct("gain_loss_percent", "symbol")
    return priced.groupBy("portfolio_id").agg(F.max(key).alias("b"), F.min(key).alias("w")).select(
        "portfolio_id",
        F.col("b.symbol").alias("best_symbol"),
        F.col("b.gain_loss_percent").alias("best_percent"),
        F.col("w.symbol").alias("worst_symbol"),
        F.col("w.gain_loss_percent").alias("worst_percent"),
    )


def with_info(symbols: DataFrame, info: DataFrame) -> DataFrame:
    """Name, sector, market cap and P/E of symbols; 'N/A' where unknown."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c)
    return symbols.join(info, "symbol", "left").select("symbol", *(text(c) for c in ("name", "sector", "market_cap", "pe_ratio")))
