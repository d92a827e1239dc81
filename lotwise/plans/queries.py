"""The named queries, each from the tables of a folder to one DataFrame."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import numeric as fx
from lotwise.operators import correlation, dca, holdings, returns, risk, valuation
from lotwise.operators.asof import nearest_bars
from lotwise.schemas import ANALYSIS_DAYS, HISTORY_DAYS, HISTORY_DEFAULT_DAYS, PERIODS
from lotwise.sources import files, tables
from lotwise.sources.storage import new_path, spread, stored
from lotwise.streaming import ticks as streams

QUERIES: dict = {}
#: When snapshots of the queries are taken: a parameter of theirs, never the clock.
TAKEN = datetime.datetime(2002, 1, 1, 9, 30, 0)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: fx.even(c, digits) for c in columns})


def valued(spark: SparkSession, d: str) -> DataFrame:
    return valuation.value_lots(tables.lots(spark, d), valuation.latest_prices(tables.bars(spark, d)))


GAINS = ("current_price", "current_value", "gain_loss_dollars", "gain_loss_percent")


def cents(df: DataFrame) -> DataFrame:
    """Lot figures as reports show them."""
    return rounded(df, 2, "purchase_price", *GAINS)


# -- holdings ---------------------------------------------------------------------------------


@query
def holdings_csv_roundtrip(spark, d):
    path = new_path(spark, "holdings-csv")
    files.write_holdings(tables.lots(spark, d), path)
    return rounded(files.read_holdings(spark, path), 6, "purchase_price")


@query
def holdings_add(spark, d):
    lots = tables.lots(spark, d)
    new = lots.groupBy("portfolio_id").agg(F.lower(F.min("symbol")).alias("symbol"), F.count(F.lit(1)).cast("double").alias("shares"), F.max("purchase_date").alias("purchase_date"))
    grown = holdings.add(lots, new.withColumn("purchase_price", F.lit(100.0)))
    return grown.groupBy("portfolio_id", "symbol").agg(F.count(F.lit(1)).alias("lots"), fx.even(F.sum("shares"), 4).alias("shares"))


@query
def holdings_remove(spark, d):
    left = holdings.remove(tables.lots(spark, d), "brand#7")
    return left.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("lots"), fx.even(F.sum("shares"), 4).alias("shares"))


@query
def holdings_symbols(spark, d):
    return holdings.symbols(tables.lots(spark, d))


# -- prices -----------------------------------------------------------------------------------


@query
def price_history_period(spark, d):
    return rounded(returns.in_period(tables.bars(spark, d), tables.as_of(spark, d), HISTORY_DEFAULT_DAYS), 6, "close", "high", "low")


@query
def latest_price(spark, d):
    return rounded(valuation.latest_prices(tables.bars(spark, d)), 6, "price")


@query
def latest_prices_for_holdings(spark, d):
    held = holdings.symbols(tables.lots(spark, d))
    return rounded(valuation.latest_prices(tables.bars(spark, d).join(held, "symbol", "left_semi")), 6, "price")


@query
def holdings_price_history(spark, d):
    held = holdings.symbols(tables.lots(spark, d))
    rows = returns.in_period(tables.bars(spark, d), tables.as_of(spark, d), ANALYSIS_DAYS)
    return rounded(rows.join(held, "symbol", "left_semi").select("symbol", "date", "close"), 6, "close")


@query
def security_info(spark, d):
    items = tables.table(spark, d, "lineitem")
    asked = items.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol")).distinct()
    other = tables.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return valuation.with_info(asked.unionByName(other), tables.security_info(spark, d))


@query
def price_trend(spark, d):
    """The series of every symbol, in order."""
    return rounded(tables.bars(spark, d).select("symbol", "date", "close"), 6, "close").orderBy("symbol", "date")


@query
def min_history_symbols(spark, d):
    return returns.enough_history(returns.in_period(tables.bars(spark, d), tables.as_of(spark, d), 30), ["symbol"])


@query
def numeric_coercion(spark, d):
    """Values out of text, of which some are none."""
    events = tables.table(spark, d, "events").select("event_id", "event_type", F.col("value").cast("string").alias("value"))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "value")).otherwise(F.col("value"))
    return events.select("event_id", fx.even(fx.as_number(text), 4).alias("number"))


# -- valuation --------------------------------------------------------------------------------


@query
def holdings_valuation(spark, d):
    return cents(valued(spark, d))


@query
def valuation_export(spark, d):
    path = new_path(spark, "valuation-csv")
    files.write_report(cents(valued(spark, d)), path)
    columns = "portfolio_id long, symbol string, shares double, purchase_price double, purchase_date date, current_price double, current_value double, gain_loss_dollars double, gain_loss_percent double"
    return spark.read.schema(columns).option("header", True).csv(path)


@query
def portfolio_summary(spark, d):
    names = tables.portfolios(spark, d)
    return valuation.summarize(valued(spark, d)).join(names, "portfolio_id", "left").withColumn("as_of_date", F.lit(tables.as_of(spark, d)).cast("date"))


@query
def asset_allocation(spark, d):
    return rounded(valuation.allocate(valued(spark, d)).select("portfolio_id", "symbol", "purchase_date", "shares", "current_value", "allocation_percent"), 2, "current_value")


@query
def asset_allocation_by_symbol(spark, d):
    return rounded(valuation.allocate(valued(spark, d), by_symbol=True), 2, "current_value")


@query
def concentration(spark, d):
    rows = valuation.concentrate(valued(spark, d)).select("portfolio_id", "symbol", "purchase_date", "shares", "percent", "band")
    return rounded(rows, 4, "percent")


@query
def invested_vs_current(spark, d):
    cost = fx.exact_sum(F.col("shares") * F.col("purchase_price"))
    rows = spread(valued(spark, d), tables.size(spark, d, "lineitem"), "portfolio_id")
    return rows.groupBy("portfolio_id", "symbol").agg(fx.even(cost, 2).alias("invested"), fx.even(fx.exact_sum(F.col("current_value")), 2).alias("current"))


@query
def gain_loss_class(spark, d):
    rows = valued(spark, d).withColumn("class", fx.gain_class(fx.even("gain_loss_dollars", 4)))
    return rows.groupBy("portfolio_id", "class").agg(F.count(F.lit(1)).alias("lots"))


@query
def best_performers(spark, d):
    return cents(valuation.performers(valued(spark, d), 5))


@query
def worst_performers(spark, d):
    return cents(valuation.performers(valued(spark, d), 5, best=False))


@query
def performance_ranking(spark, d):
    return cents(valuation.performers(valued(spark, d), None))


@query
def best_worst_kpi(spark, d):
    return rounded(valuation.extremes(valued(spark, d)), 2, "best_percent", "worst_percent")


@query
def holdings_report(spark, d):
    rows = valued(spark, d)
    return rows.select(
        "portfolio_id",
        F.col("symbol").alias("Symbol"),
        F.col("purchase_date").alias("Bought"),
        F.col("shares").alias("Shares"),
        fx.even("current_price", 2).alias("Price"),
        fx.even("current_value", 2).alias("Value"),
        fx.even("gain_loss_percent", 2).alias("Gain"),
    )


@query
def report_formatting(spark, d):
    s = valuation.summarize(valued(spark, d))
    return s.select(
        "portfolio_id",
        fx.currency(F.col("total_current_value")).alias("value_text"),
        fx.currency(F.col("total_gain_loss_dollars")).alias("gain_text"),
        fx.percent(F.col("total_gain_loss_percent")).alias("percent_text"),
        fx.signed(F.col("total_gain_loss_percent")).alias("signed_text"),
        fx.whole_currency(F.col("total_current_value")).alias("whole_text"),
        fx.percent_of_one(F.col("total_gain_loss_percent") / 100, 1).alias("tenth_text"),
        fx.percent_of_one(F.col("total_gain_loss_percent") / 100, 2).alias("fraction_text"),
    )


@query
def report_timestamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    return tables.table(spark, d, "events").select(
        "event_id",
        F.date_format(ts, "yyyy-MM-dd").alias("day_text"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("utc_text"),
        fx.display_time(ts).alias("local_text"),
        F.unix_timestamp(ts).alias("epoch"),
    )


# -- snapshots --------------------------------------------------------------------------------


@query
def portfolio_snapshot_json(spark, d):
    rows = cents(valued(spark, d))
    summary = valuation.summarize(valued(spark, d)).join(tables.portfolios(spark, d), "portfolio_id", "left")
    documents = files.snapshot_documents(rows, summary, TAKEN)
    parsed = F.from_json("document", "timestamp long, datetime string, summary struct<portfolio_name:string,total_current_value:double,number_of_holdings:long>, holdings array<struct<symbol:string>>")
    return documents.select("portfolio_id", parsed.alias("p")).select(
        "portfolio_id", "p.datetime", "p.timestamp", "p.summary.portfolio_name", "p.summary.total_current_value", "p.summary.number_of_holdings", F.size("p.holdings").cast("long").alias("lots"), F.get("p.holdings", F.lit(0))["symbol"].alias("first_symbol")
    )


def _history(spark, d):
    rows = valued(spark, d)
    return files.history_rows(rows, valuation.summarize(rows), TAKEN)


@query
def portfolio_history_rows(spark, d):
    path = new_path(spark, "history")
    files.append_history(_history(spark, d), path)
    return spark.read.parquet(path).withColumn("taken", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("snapshot_date", "timestamp")


@query
def snapshot_totals(spark, d):
    s = valuation.summarize(valued(spark, d))
    return s.select("portfolio_id", F.lit(TAKEN.date()).alias("date"), F.col("total_current_value").alias("total_value"), F.col("total_gain_loss_percent").alias("return_pct"))


@query
def recent_history(spark, d):
    """The 100 newest rows after two snapshots, a day apart."""
    path, rows = new_path(spark, "history"), valued(spark, d)
    summary = valuation.summarize(rows)
    for late in (0, 1):
        files.append_history(files.history_rows(rows, summary, TAKEN + datetime.timedelta(days=late)), path)
    out = files.recent_history(spark, path, TAKEN.date(), 100)
    return out.select("portfolio_id", "stock_symbol", "purchase_date", "shares", "current_value", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("taken"))


# -- series and risk --------------------------------------------------------------------------


def recent_bars(spark, d, days=ANALYSIS_DAYS):
    return returns.in_period(tables.bars(spark, d), tables.as_of(spark, d), days)


@query
def daily_returns(spark, d):
    return rounded(returns.with_returns(recent_bars(spark, d), ["symbol"]).select("symbol", "date", "ret"), 8, "ret")


@query
def running_peak(spark, d):
    return rounded(returns.with_returns(tables.bars(spark, d), ["symbol"]).select("symbol", "date", "peak"), 6, "peak")


@query
def drawdown_series(spark, d):
    return rounded(returns.with_returns(tables.bars(spark, d), ["symbol"]).select("symbol", "date", "drawdown"), 6, "drawdown")


RISK = ("volatility", "sharpe_ratio", "max_drawdown", "max_drawdown_relative", "avg_return")


@query
def risk_metrics(spark, d):
    return rounded(risk.measure(recent_bars(spark, d), ["symbol"]).select("symbol", "volatility", "sharpe_ratio", "max_drawdown", "avg_return"), 6, "volatility", "sharpe_ratio", "max_drawdown", "avg_return")


def _one(name, source="volatility"):
    def run(spark, d):
        return risk.measure(recent_bars(spark, d), ["symbol"]).select("symbol", fx.even(source, 6).alias(name))

    QUERIES[name] = run


_one("volatility", "raw_volatility")
for _name in RISK[1:]:
    _one(_name, _name)


@query
def risk_by_period(spark, d):
    rows = returns.by_period(tables.bars(spark, d), tables.as_of(spark, d), PERIODS)
    return rounded(risk.measure(rows, ["days", "symbol"]).select("days", "symbol", *RISK), 6, *RISK)


# metrics beside the built-in ones, as a user adds them
risk.register("downside_volatility", lambda a: risk.yearly(a["below"]), below=lambda: F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))))
risk.register("best_day", lambda a: a["best"], best=lambda: F.max("ret"))
risk.register("worst_day", lambda a: a["worst"], worst=lambda: F.min("ret"))
risk.register("share_of_gains", lambda a: fx.ratio(a["gains"].cast("double"), a["days"].cast("double")), gains=lambda: F.count(F.when(F.col("ret") > 0, 1)), days=lambda: F.count("ret"))
EXTRA = ("downside_volatility", "best_day", "worst_day", "share_of_gains")


@query
def risk_more_metrics(spark, d):
    columns = ("volatility", "sharpe_ratio", *EXTRA)
    return rounded(risk.measure(recent_bars(spark, d), ["symbol"], EXTRA).select("symbol", *columns), 6, *columns)


@query
def risk_report(spark, d):
    r = risk.measure(recent_bars(spark, d), ["symbol"])
    text = lambda c: F.format_string("%.2f%%", fx.even(F.col(c) * 100, 2))
    return r.select(F.col("symbol").alias("Symbol"), text("volatility").alias("Volatility"), F.format_string("%.2f", fx.even("sharpe_ratio", 2)).alias("Sharpe"), text("max_drawdown").alias("Drawdown"), text("avg_return").alias("Return"))


@query
def price_positional_align(spark, d):
    return rounded(correlation.align_by_position(recent_bars(spark, d)), 6, "close")


@query
def correlation_matrix(spark, d):
    return rounded(correlation.correlate(correlation.align_by_position(recent_bars(spark, d)), "pos"), 6, "corr")


@query
def correlation_by_date(spark, d):
    return rounded(correlation.correlate(recent_bars(spark, d), "date"), 6, "corr")


@query
def holdings_risk(spark, d):
    """Risk figures of the symbols that each portfolio holds."""
    rows = holdings.by_portfolio(tables.lots(spark, d), risk.measure(recent_bars(spark, d), ["symbol"]))
    return rounded(rows.select("portfolio_id", "symbol", *RISK), 6, *RISK)


@query
def holdings_correlation(spark, d):
    """Correlation among the symbols that each portfolio holds, aligned by position."""
    return rounded(correlation.correlate_held(tables.lots(spark, d), recent_bars(spark, d)), 6, "corr")


# -- backtests --------------------------------------------------------------------------------


def history(spark, d):
    return returns.in_period(tables.bars(spark, d), tables.as_of(spark, d), HISTORY_DAYS)


def tested(spark, d):
    return dca.backtest(tables.strategies(spark, d), tables.strategy_symbols(spark, d), history(spark, d))


@query
def dca_equal_weights(spark, d):
    plain = tables.strategy_symbols(spark, d).withColumn("weight", F.lit(None).cast("double"))
    return rounded(dca.weigh(plain), 6, "share")


@query
def dca_normalized_weights(spark, d):
    return rounded(dca.weigh(tables.strategy_symbols(spark, d)), 6, "share")


@query
def dca_strategy_validation(spark, d):
    return dca.validate(tables.strategies(spark, d), tables.strategy_symbols(spark, d))


@query
def dca_schedule(spark, d):
    return dca.schedule(dca.dealt(tables.strategies(spark, d))).select("strategy_id", F.col("month").cast("date").alias("month"), "target")


@query
def dca_trade_dates(spark, d):
    return dca.trade_dates(tested(spark, d).traded)


@query
def asof_nearest_price(spark, d):
    """Nearest closes for the days on which lots were bought."""
    wanted = tables.lots(spark, d).select("symbol", F.col("purchase_date").alias("target")).distinct()
    near = stored(nearest_bars(history(spark, d)), "near")
    return wanted.join(near, ["symbol", "target"], "left").select("symbol", "target", F.expr("date_add(target, off)").alias("found"), fx.even("close", 6).alias("price"))


@query
def dca_fills(spark, d):
    return tested(spark, d).filled.select("strategy_id", "month", "symbol", fx.even("price", 4).alias("price"), fx.even("bought_shares", 6).alias("bought_shares"))


@query
def dca_cumulative_shares(spark, d):
    return tested(spark, d).filled.select("strategy_id", "month", "symbol", fx.even("shares", 6).alias("shares"))


@query
def dca_monthly(spark, d):
    return dca.monthly(tested(spark, d).filled).drop("invested")


def _summary(spark, d):
    t = tested(spark, d)
    return dca.summarize(tables.strategies(spark, d), t.weighed, t.filled, t.near)


@query
def dca_summary(spark, d):
    return _summary(spark, d)


@query
def dca_reported_errors(spark, d):
    return dca.reported_errors(_summary(spark, d))


def _final(spark, d):
    t = tested(spark, d)
    bars = t.near.where("off = 0").select("symbol", F.col("target").alias("date"), "close")  # a bar is the nearest to its own day
    return dca.final_holdings(t.filled, bars)


@query
def dca_holdings_final(spark, d):
    return _final(spark, d)


@query
def dca_final_allocation(spark, d):
    rows = _final(spark, d)
    whole = F.sum("current_value").over(Window.partitionBy("strategy_id"))
    return rows.select("strategy_id", "symbol", fx.even(fx.ratio(F.col("current_value"), whole) * 100, 4).alias("percent"))


@query
def dca_monthly_average(spark, d):
    return _summary(spark, d).select("strategy_id", fx.even(fx.ratio(F.col("total_invested"), F.col("months_simulated")), 2).alias("average"))


@query
def dca_vs_actual(spark, d):
    """Simulated and actual figures of each customer, as two rows."""
    columns = [F.col("total_invested").alias("invested"), "current", "percent"]
    simulated = _summary(spark, d).where("success").withColumn("current", F.col("final_value")).withColumn("percent", F.col("gain_loss_percent"))
    actual = valuation.summarize(valued(spark, d)).withColumn("current", F.col("total_current_value")).withColumn("percent", F.col("total_gain_loss_percent"))
    a = simulated.select(F.col("strategy_id").alias("id"), F.lit("simulated").alias("type"), *columns)
    return a.unionByName(actual.select(F.col("portfolio_id").alias("id"), F.lit("actual").alias("type"), *columns))


@query
def dca_holdings_map(spark, d):
    """What a strategy holds after each month: symbol to shares, as JSON."""
    held = tested(spark, d).filled.groupBy("strategy_id", "month").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "shares")))).alias("holdings"))
    shares = F.transform_values("holdings", lambda _, n: fx.even(n, 4).cast("decimal(18,4)"))
    return held.select("strategy_id", "month", F.to_json(shares).alias("holdings"), F.size("holdings").alias("symbols"))


@query
def dca_monthly_nested(spark, d):
    """The monthly records of a strategy in order, as JSON."""
    record = F.struct("date", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("total_invested", "portfolio_value", "gain_loss")))
    rows = dca.monthly(tested(spark, d).filled).groupBy("strategy_id").agg(F.sort_array(F.collect_list(record)).alias("monthly_data"))
    return rows.select("strategy_id", F.size("monthly_data").alias("months"), F.to_json("monthly_data").alias("monthly_data"))


# -- streams ----------------------------------------------------------------------------------


@query
def stream_latest_price(spark, d):
    job = streams.LatestPrices(spark, new_path(spark, "latest"))
    job.drain(streams.read_ticks(spark, d))
    return job.table().select("symbol", "price")


@query
def stream_portfolio_summary(spark, d):
    job = streams.LiveSummary(spark, new_path(spark, "live-summary")).open(tables.tick_lots(spark, d))
    job.drain(streams.read_ticks(spark, d))
    return job.table()


def _bars(spark, d):
    job = streams.Bars(spark, new_path(spark, "bars"))
    job.drain(streams.read_ticks(spark, d))
    return job


@query
def stream_daily_bars(spark, d):
    return _bars(spark, d).daily()


@query
def stream_hourly_snapshot(spark, d):
    return _bars(spark, d).hourly().select("symbol", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "price")
