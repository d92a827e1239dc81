"""Risk figures per series, all from one aggregate over the returns frame, open to further metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numeric import ratio
from lotwise.operators.returns import with_returns
from lotwise.schemas import TRADING_DAYS

YEAR = float(TRADING_DAYS)


@dataclass(frozen=True)
class Metric:
    """Aggregates over a series (its columns close, filled, ret, peak, drawdown and date), each a function
    that makes a Column, and the figure made of them, a function of the mapping of their names to Columns."""

    value: Callable[[Mapping[str, Column]], Column]
    aggregates: Mapping[str, Callable[[], Column]]


METRICS: dict[str, Metric] = {}


def register(name: str, value: Callable[[Mapping[str, Column]], Column], **aggregates: Callable[[], Column]) -> None:
    """Adds a metric that ``measure`` computes on demand, in the same pass as its own.

    register("best_day", lambda a: a["best"], best=lambda: F.max("ret"))"""
    if name in METRICS:
        raise ValueError(f"there is a metric {name}")
    if not aggregates:
        raise ValueError(f"metric {name} has no aggregates")
    METRICS[name] = Metric(value, aggregates)


def yearly(deviation: Column) -> Column:
    return deviation * F.sqrt(F.lit(YEAR))


_DEVIATION = {"sd": lambda: F.stddev_samp("ret")}
_MEAN = {"mean": lambda: F.avg("ret")}
register("volatility", lambda a: F.when(a["sd"] > 0, yearly(a["sd"])).otherwise(0.0), **_DEVIATION)
register("sharpe_ratio", lambda a: F.when(a["sd"] > 0, yearly(ratio(a["mean"], a["sd"]))).otherwise(0.0), **_DEVIATION, **_MEAN)
register("max_drawdown", lambda a: ratio(a["fall"], a["top"]), fall=lambda: F.max("drawdown"), top=lambda: F.max("peak"))
register("max_drawdown_relative", lambda a: a["fall"], fall=lambda: F.max(ratio(F.col("drawdown"), F.col("peak"))))
register("avg_return", lambda a: a["mean"] * YEAR, **_MEAN)
register("raw_volatility", lambda a: yearly(a["sd"]), **_DEVIATION)
BUILT_IN = tuple(METRICS)


def measure(bars: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """volatility, sharpe_ratio, max_drawdown (over the greatest peak), max_drawdown_relative (over the
    peak of the day), avg_return, raw_volatility, which is NULL with a single return, and the registered
    metrics named in ``extra``. Series of less than two bars are left out."""
    names = (*BUILT_IN, *extra)
    unknown = [name for name in names if name not in METRICS]
    if unknown:
        raise KeyError(f"no such metric: {', '.join(unknown)}")
    columns = {(name, part): f"{name}.{part}" for name in names for part in METRICS[name].aggregates}
    aggregates = [METRICS[name].aggregates[part]().alias(column) for (name, part), column in columns.items()]
    stats = with_returns(bars, keys).groupBy(*keys).agg(*aggregates, F.count("ret").alias("returns"))
    figure = lambda name: METRICS[name].value({part: F.col(f"`{columns[name, part]}`") for part in METRICS[name].aggregates})
    return stats.where(F.col("returns") >= 1).select(*keys, *(figure(name).alias(name) for name in names))
