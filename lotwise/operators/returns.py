"""Series over bars: periods, returns, peaks, drawdowns."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.numeric import ratio


def in_period(bars: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """Bars of the ``days`` days before ``as_of``, which is itself left out."""
    end = F.lit(as_of).cast("date")
    return bars.where((F.col("date") >= F.date_sub(end, days)) & (F.col("date") < end))


def by_period(bars: DataFrame, as_of: datetime.date, periods: tuple[int, ...]) -> DataFrame:
    """Every period's bars in one table, with the column ``days``."""
    end = F.lit(as_of).cast("date")
    age = F.datediff(end, "date")
    rows = in_period(bars, as_of, max(periods)).withColumn("days", F.explode(F.filter(F.array(*map(F.lit, periods)), lambda d: d >= age)))
    return rows


def enough_history(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Series with at least two bars."""
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars")).where(F.col("bars") >= 2)


def with_returns(bars: DataFrame, keys: list[str], fill: bool = True) -> DataFrame:
    """Bars with ret (daily return over closes carried forward), peak (running maximum) and drawdown.

    All windows share one partitioning and sort."""
    series = Window.partitionBy(*keys).orderBy("date")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last("close", ignorenulls=True).over(so_far) if fill else F.col("close")
    rows = bars.withColumn("filled", filled)
    rows = rows.withColumn("ret", ratio(F.col("filled"), F.lag("filled").over(series)) - 1)
    return rows.withColumn("peak", F.max("close").over(so_far)).withColumn("drawdown", F.col("peak") - F.col("close"))
