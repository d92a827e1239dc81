"""Nearest bar within some days of any wanted day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.schemas import NEAREST_DAYS


def nearest_bars(bars: DataFrame, days: int = NEAREST_DAYS) -> DataFrame:
    """(symbol, target, off, close): for every day near a bar, the nearest bar, the earlier one of two.

    The bars are spread over the days around them once, so wanted days find theirs by an equi-join,
    however many there are. A bar without a close still wins its day: no neighbour stands in."""
    spread = bars.select("symbol", "close", "date", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("off"))
    spread = spread.select("symbol", F.expr("date_sub(date, off)").alias("target"), "off", "close")
    key = F.struct(F.abs("off"), F.col("off"))
    return spread.groupBy("symbol", "target").agg(F.min_by(F.struct("off", "close"), key).alias("b")).select("symbol", "target", "b.off", "b.close")
