"""Views of the star schema as holdings, bars, ticks, securities and strategies."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.sources.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, from its footers."""
    return table(spark, sf_dir, name).count()


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per purchase lot: portfolio_id, symbol, shares, purchase_price, purchase_date."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = size(spark, sf_dir, "lineitem")
    return (
        items.join(spread(parts, rows, "l_partkey"), "l_partkey")
        .join(spread(orders, rows, "l_orderkey"), "l_orderkey")
        .select(
            F.col("o_custkey").alias("portfolio_id"),
            F.upper("p_brand").alias("symbol"),
            F.col("l_quantity").alias("shares"),
            F.try_divide("l_extendedprice", "l_quantity").alias("purchase_price"),
            F.col("o_orderdate").cast("date").alias("purchase_date"),
        )
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of every symbol: volume-weighted close (summed exactly), unit-price high and low, volume."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_brand").alias("symbol"))
    unit = F.try_divide("l_extendedprice", "l_quantity")
    return (
        items.join(spread(parts, size(spark, sf_dir, "lineitem"), "l_partkey"), "l_partkey")
        .groupBy("symbol", "date")
        .agg(
            F.try_divide(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), F.sum("l_quantity")).alias("close"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def as_of(spark: SparkSession, sf_dir: str) -> datetime.date:
    """The day after the last bar."""
    last = table(spark, sf_dir, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
    return (last or datetime.date(1970, 1, 1)) + datetime.timedelta(days=1)


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def tick_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots over tick symbols: every event with a value opens a lot of its user's symbol."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.pmod("event_id", F.lit(97)).alias("portfolio_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        (F.pmod("event_id", F.lit(9)) + 1).cast("double").alias("shares"),
        F.col("value").alias("purchase_price"),
        F.col("ts").cast("date").alias("purchase_date"),
    )


def security_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("sector"),
        F.lit(None).cast("double").alias("market_cap"),
        F.lit(None).cast("double").alias("pe_ratio"),
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.col("c_name").alias("portfolio_name"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly-investment strategy per customer: start, end, monthly_amount, purchase_day."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1994-12-20").cast("date"), F.pmod(k * 37, F.lit(2000)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("strategy_id"),
        start.alias("start"),
        F.date_add(start, (F.pmod(k * 13, F.lit(1500)) - 20).cast("int")).alias("end"),
        (F.abs(F.floor("c_acctbal")) + 50).cast("double").alias("monthly_amount"),
        (F.pmod(k, F.lit(31)) + 1).cast("int").alias("purchase_day"),
    )


def numbered(symbols: DataFrame) -> DataFrame:
    """(symbol, idx): places in order from 0. Ranks are counted inside groups of a common beginning; only
    the sizes of the groups, one row each, are added up in one task."""
    head = F.substring("symbol", 1, 7)
    inside = symbols.select("symbol", head.alias("head"), F.row_number().over(Window.partitionBy(head).orderBy("symbol")).alias("rank"))
    sizes = symbols.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    return inside.join(sizes, "head").select("symbol", (F.col("rank") + F.col("below") - 1).alias("idx"))


#: Strategies pick among so many symbols, the first in order.
PLACES = 25


def strategy_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy_id, symbol, weight, bought): up to four symbols of each strategy. Every fourth
    strategy has no weights; in every fifth one symbol has a weight but is not bought."""
    brands = table(spark, sf_dir, "part").select(F.upper("p_brand").alias("symbol")).distinct()
    brands = numbered(brands).where(F.col("idx") < PLACES)
    k, j = F.col("strategy_id"), F.col("j")
    owners = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("strategy_id")), 4 * size(spark, sf_dir, "customer"), "strategy_id")
    picks = owners.select("strategy_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    picks = picks.groupBy("strategy_id", F.pmod(k * (j + 1) + j * j, F.lit(PLACES)).cast("int").alias("idx")).agg(F.min("j").alias("j"))
    return picks.join(F.broadcast(brands), "idx").select(
        "strategy_id",
        "symbol",
        F.when(F.pmod(k, F.lit(4)) != 0, (F.pmod(k + j, F.lit(3)) + 1).cast("double")).alias("weight"),
        (~((j == 3) & (F.pmod(k, F.lit(5)) == 0))).alias("bought"),
    )


#: The same views as SQL, for the oracles.
VIEWS = """
lots AS (SELECT o_custkey AS portfolio_id, upper(p_brand) AS symbol, l_quantity AS shares, l_extendedprice / nullif(l_quantity, 0) AS purchase_price,
  CAST(o_orderdate AS DATE) AS purchase_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
bars AS (SELECT upper(p_brand) AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(sum(l_quantity), 0) AS close,
  max(l_extendedprice / nullif(l_quantity, 0)) AS high, min(l_extendedprice / nullif(l_quantity, 0)) AS low, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
as_of AS (SELECT CAST(max(l_shipdate) AS DATE) + 1 AS day FROM lineitem),
latest AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY 1),
ticks AS (SELECT 'U' || user_id AS symbol, ts, value AS price, event_id FROM events),
tick_lots AS (SELECT event_id % 97 AS portfolio_id, 'U' || user_id AS symbol, CAST(event_id % 9 + 1 AS DOUBLE) AS shares, value AS purchase_price,
  CAST(ts AS DATE) AS purchase_date FROM events),
info AS (SELECT 'P' || p_partkey AS symbol, p_name AS name, p_type AS sector FROM part),
portfolios AS (SELECT c_custkey AS portfolio_id, c_name AS portfolio_name FROM customer),
strategies AS (SELECT c_custkey AS strategy_id, DATE '1994-12-20' + CAST(c_custkey * 37 % 2000 AS INT) AS start,
  DATE '1994-12-20' + CAST(c_custkey * 37 % 2000 AS INT) + CAST(c_custkey * 13 % 1500 - 20 AS INT) AS "end",
  CAST(abs(floor(c_acctbal)) + 50 AS DOUBLE) AS monthly_amount, CAST(c_custkey % 31 + 1 AS INT) AS purchase_day FROM customer),
brands AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS idx FROM (SELECT DISTINCT upper(p_brand) AS symbol FROM part)),
picks AS (SELECT c_custkey AS strategy_id, (c_custkey * (j + 1) + j * j) % 25 AS idx, CASE WHEN c_custkey % 4 <> 0 THEN CAST((c_custkey + j) % 3 + 1 AS DOUBLE) END AS weight,
  NOT (j = 3 AND c_custkey % 5 = 0) AS bought, j FROM customer, range(4) r(j)),
strategy_symbols AS (SELECT strategy_id, symbol, weight, bought FROM picks JOIN brands USING (idx) QUALIFY row_number() OVER (PARTITION BY strategy_id, idx ORDER BY j) = 1)
"""
