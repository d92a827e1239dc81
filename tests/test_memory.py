"""What one task holds: tasks follow the rows of the tables, not the session's number of shuffle partitions."""

import contextlib
import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.operators import dca
from lotwise.plans import queries
from lotwise.plans.registry import ORACLE, QUERIES
from lotwise.sources import storage, tables
from test_queries import FOLDER, duck, needs_data, plain  # noqa: F401

D = datetime.date
#: Query: rows that a task gets, of some thousands.
NAMED = {
    "dca_vs_actual": 1000,
    "dca_monthly_nested": 1000,
    "dca_monthly": 1000,
    "dca_cumulative_shares": 1000,
    "invested_vs_current": 1000,
    "dca_final_allocation": 1000,
    "asof_nearest_price": 1000,
    "dca_holdings_map": 1000,
    "dca_holdings_final": 1000,
    "dca_summary": 1000,
    "dca_normalized_weights": 100,
    "dca_trade_dates": 1000,
}


def most(df):
    """Rows of the largest partition."""
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@needs_data
@pytest.mark.parametrize("name", sorted(NAMED))
def test_many_tasks_give_the_same_rows(spark, duck, name, monkeypatch):  # noqa: F811
    asked = []
    frame = type(spark.range(0))
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *keys: asked.append(n) or deal(df, n, *keys))
    monkeypatch.setattr(storage, "TASK_ROWS", NAMED[name], raising=False)
    df = QUERIES[name](spark, FOLDER)
    assert max(asked, default=0) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    at = [[x[0] for x in result.description].index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(row[k]) for k in at]) for row in result.fetchall())


def test_a_task_holds_its_share_of_the_fills(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100, raising=False)
    strategies = spark.createDataFrame([(k, D(2023, 1, 1), D(2023, 12, 31), 100.0, 3) for k in range(120)], "strategy_id int, start date, end date, monthly_amount double, purchase_day int")
    symbols = spark.createDataFrame([(k, s, 1.0, True) for k in range(120) for s in "AB"], "strategy_id int, symbol string, weight double, bought boolean")
    bars = spark.createDataFrame([(s, D(2023, m, 3), 10.0) for m in range(1, 13) for s in "AB"], "symbol string, date date, close double")
    t = dca.backtest(strategies, symbols, bars)
    assert t.filled.count() == 120 * 12 * 2 and dca.trade_dates(t.traded).count() == 120 * 12
    assert most(t.filled) <= 400 and most(dca.monthly(t.filled)) <= 200


@contextlib.contextmanager
def no_broadcasts(spark, key="spark.sql.autoBroadcastJoinThreshold"):
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def year_of_two(spark):
    """120 strategies with two symbols each over a year, and bars of a symbol that none has."""
    strategies = spark.createDataFrame([(k, D(2023, 1, 1), D(2023, 12, 31), 100.0, 3) for k in range(120)], "strategy_id int, start date, end date, monthly_amount double, purchase_day int")
    symbols = spark.createDataFrame([(k, s, 1.0, True) for k in range(120) for s in "AB"], "strategy_id int, symbol string, weight double, bought boolean")
    bars = spark.createDataFrame([(s, D(2023, m, 3), float(m)) for m in range(1, 13) for s in "ABZ"], "symbol string, date date, close double")
    return strategies, symbols, bars


def test_bars_of_other_symbols_are_left_out(spark):
    near = dca.backtest(*year_of_two(spark)).near
    assert sorted(r[0] for r in near.select("symbol").distinct().collect()) == ["A", "B"]


def test_more_bars_than_are_broadcast_are_joined_in_tasks_by_rows(spark, monkeypatch):
    given = year_of_two(spark)
    whole = sorted(dca.backtest(*given).filled.collect())
    assert len(whole) == 120 * 12 * 2
    monkeypatch.setattr(dca, "BROADCAST_BARS", 0)
    monkeypatch.setattr(storage, "TASK_ROWS", 100, raising=False)
    with no_broadcasts(spark):
        t = dca.backtest(*given)
        assert sorted(t.filled.collect()) == whole
        assert most(t.traded) <= 400 and most(t.filled) <= 400
    bars = t.near.where("off = 0").select("symbol", F.col("target").alias("date"), "close")
    assert sorted(map(tuple, dca.final_holdings(t.filled, bars).collect())) == sorted((k, s, float(f"{sum(50 / m for m in range(1, 13)):.4f}"), 12.0, round(12 * sum(50 / m for m in range(1, 13)), 2)) for k in range(120) for s in "AB")


@needs_data
def test_months_are_not_broadcast(spark):
    t = queries.tested(spark, FOLDER)
    assert t.planned.count() > t.weighed.count()
    plan = t.traded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [strategy_id" in plan and "BuildLeft" not in plan


@needs_data
def test_symbols_of_a_strategy_lie_together(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 50, raising=False)
    rows = tables.strategy_symbols(spark, FOLDER)
    assert rows.count() > 400 and most(rows) <= 150
    assert rows.select("strategy_id", F.spark_partition_id().alias("p")).distinct().count() == rows.select("strategy_id").distinct().count()


def test_rows_of_a_few_tasks_use_all_cores(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100, raising=False)
    parts = lambda rows: storage.spread(spark.range(rows).coalesce(1), rows, "id").rdd.getNumPartitions()
    assert (parts(100), parts(300), parts(1000)) == (1, spark.sparkContext.defaultParallelism, 10)
