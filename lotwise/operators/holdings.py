"""Editing holdings: lots are appended and dropped, never merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(holdings: DataFrame, new: DataFrame) -> DataFrame:
    """Appends lots, symbols in upper case; equal lots stay separate rows."""
    return holdings.unionByName(new.withColumn("symbol", F.upper("symbol")))


def remove(holdings: DataFrame, symbol: str) -> DataFrame:
    """Drops all lots of a symbol."""
    return holdings.where(~F.col("symbol").eqNullSafe(F.upper(F.lit(symbol))))


def symbols(holdings: DataFrame) -> DataFrame:
    return holdings.select("symbol").distinct()


def by_portfolio(holdings: DataFrame, series: DataFrame) -> DataFrame:
    """``series`` (symbol, ...) of the symbols that each portfolio holds, with portfolio_id."""
    return holdings.select("portfolio_id", "symbol").distinct().join(series, "symbol")
