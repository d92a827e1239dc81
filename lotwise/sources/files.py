"""CSV holdings, report files, snapshot documents and the append-only history."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.numeric import money
from lotwise.schemas import HOLDINGS
from lotwise.sources.storage import file_system


def write_holdings(holdings: DataFrame, path: str) -> None:
    holdings.select(*HOLDINGS.fieldNames()).write.option("header", True).csv(path)


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of CSV files with a header; symbols in upper case, malformed rows fail."""
    rows = spark.read.schema(HOLDINGS).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("symbol", F.upper("symbol"))


def write_report(valued: DataFrame, path: str) -> None:
    """The valuation as CSV with a header."""
    valued.write.option("header", True).csv(path)


def snapshot_documents(valued: DataFrame, summary: DataFrame, taken: datetime.datetime) -> DataFrame:
    """(portfolio_id, document): summary (all its columns, the portfolio's name with them) and lots of a
    portfolio as one JSON document."""
    lot = F.struct("symbol", "purchase_date", "shares", "purchase_price", "current_price", "current_value", "gain_loss_dollars", "gain_loss_percent")
    lots = valued.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(lot)).alias("holdings"))
    body = F.struct(
        F.lit(int(taken.replace(tzinfo=datetime.timezone.utc).timestamp())).alias("timestamp"),
        F.lit(taken.strftime("%Y-%m-%d %H:%M:%S")).alias("datetime"),
        F.struct(*(c for c in summary.columns if c != "portfolio_id")).alias("summary"),
        "holdings",
    )
    return lots.join(summary, "portfolio_id").select("portfolio_id", F.to_json(body).alias("document"))


def history_rows(valued: DataFrame, summary: DataFrame, taken: datetime.datetime) -> DataFrame:
    """One row per lot with its portfolio's totals, as appended to the history."""
    whole = summary.select("portfolio_id", F.col("total_current_value").alias("total_portfolio_value"), F.col("total_gain_loss_percent").alias("total_return_percent"))
    return valued.join(whole, "portfolio_id").select(
        "portfolio_id",
        F.lit(taken).cast("timestamp").alias("timestamp"),
        F.col("symbol").alias("stock_symbol"),
        "purchase_date",
        "shares",
        *(money(F.col(c)).alias(c) for c in ("current_price", "current_value", "gain_loss_dollars", "gain_loss_percent")),
        "total_portfolio_value",
        "total_return_percent",
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Appends a snapshot, one folder per day, so that reads of recent days prune the rest."""
    rows.withColumn("snapshot_date", F.to_date("timestamp")).write.mode("append").partitionBy("snapshot_date").parquet(path)


def snapshot_days(spark: SparkSession, path: str) -> list[datetime.date]:
    """The days that a history has folders of, newest first; from the listing alone."""
    folder, system = file_system(spark, path)
    names = (s.getPath().getName().partition("=") for s in system.listStatus(folder))
    return sorted((datetime.date.fromisoformat(day) for name, _, day in names if name == "snapshot_date" and day[:1].isdigit()), reverse=True)


def recent_history(spark: SparkSession, path: str, since: datetime.date, n: int) -> DataFrame:
    """The ``n`` newest rows from ``since`` on. Days are walked from the newest, twice as many each time,
    until they hold ``n`` rows (counted by the files' footers); older ones are not read."""
    days, taken, rows, step = [d for d in snapshot_days(spark, path) if d >= since], [], 0, 1
    while days and rows < n:
        folders = [f"{path}/snapshot_date={d}" for d in days[:step]]
        rows += spark.read.parquet(*folders).count()
        taken, days, step = taken + folders, days[step:], 2 * step
    order = [F.desc("timestamp"), "portfolio_id", "stock_symbol", "purchase_date", "shares", "current_value"]
    found = spark.read.option("basePath", path).parquet(*taken) if taken else spark.read.parquet(path).limit(0)
    return found.orderBy(*order).limit(n)
