"""Schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Trading days of a year, for annualised figures.
TRADING_DAYS = 252
#: How far from a wanted day a price may lie.
NEAREST_DAYS = 5
#: Bars older than this are not seen by a backtest.
HISTORY_DAYS = 3650
ANALYSIS_DAYS, HISTORY_DEFAULT_DAYS = 180, 90
PERIODS = (7, 30, 90, 180, 365)
# The text of a backtest without data, what stands before other errors, and how much of these is shown.
NO_DATA = "No trading data found for selected period"
SIMULATION_ERROR, ERROR_CHARS = "Simulation error: ", 200
MIN_MONTHLY, MAX_MONTHLY, MIN_ALLOCATED = 100.0, 100_000.0, 0.99

HOLDINGS = T.StructType(
    [
        T.StructField("portfolio_id", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("shares", T.DoubleType()),
        T.StructField("purchase_price", T.DoubleType()),
        T.StructField("purchase_date", T.DateType()),
    ]
)
BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
