"""Prices from a tick stream: latest per symbol, portfolio summaries, daily bars, hourly snapshots.

A job has a folder: its checkpoint and its tables lie there, so that a new job of the same folder goes on
where the last one stopped, on this or another cluster. ``start`` returns Spark's handle of the running
query (``stop()`` it, ask it for its progress); with ``every`` it takes what has come once in that time,
without it takes all that is there and ends. Ticks have the columns symbol, ts, price, event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotwise.operators.valuation import summary_of
from lotwise.schemas import EVENTS
from lotwise.sources.tables import as_ticks
from lotwise.streaming.ledger import EVERY, Ledger, newest, summed

LATE = "1 day"
#: Zones' offsets from UTC are multiples of this, so hours and days of any zone are made up of whole ones.
QUARTER = "15 minutes"
#: Folders of lots by symbol, and parts that a folder's lots are dealt to when they are written.
SLOTS, SPREAD = 256, 4
#: Values of lots are summed as these: sums don't depend on the order, and what is taken off is what was added.
AMOUNT = "decimal(38,6)"


def read_ticks(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int | None = None) -> DataFrame:
    """Ticks of event files as they arrive in ``folder``, at most ``files`` of them at a time."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    return as_ticks((reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder))


def latest(ticks: DataFrame) -> DataFrame:
    """State: one row per symbol."""
    last = F.max(F.struct("ts", "event_id", "price"))
    return ticks.groupBy("symbol").agg(last.alias("t")).select("symbol", F.col("t.price").alias("price"), F.col("t.ts").alias("ts"))


def quarters(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """(symbol, quarter, last, high, low, volume): each symbol's quarters of an hour; ticks more than ``late``
    behind the newest are dropped, which bounds the state."""
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", QUARTER), "symbol")
    rows = rows.agg(F.max(F.struct("ts", "event_id", "price")).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("price").alias("volume"))
    return rows.select("symbol", F.col("window.start").alias("quarter"), "last", "high", "low", "volume")


class Job:
    """One query over a tick stream with all that it keeps in ``folder``."""

    mode = "update"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self, ticks: DataFrame) -> DataFrame:
        """What the query makes of the ticks."""
        raise NotImplementedError

    def write(self, rows: DataFrame, number: int) -> None:
        """Takes a batch's rows in; done twice with a batch it leaves the same."""
        raise NotImplementedError

    def start(self, ticks: DataFrame, every: str | None = None) -> StreamingQuery:
        writer = self.rows(ticks).writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.write)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def drain(self, ticks: DataFrame) -> None:
        """Takes in all that is there."""
        self.start(ticks).awaitTermination()


class LatestPrices(Job):
    """Each symbol's latest price. A batch writes the symbols that it changed."""

    def __init__(self, spark: SparkSession, folder: str, every: int = EVERY):
        super().__init__(spark, folder)
        self.prices = Ledger(spark, f"{self.folder}/prices", "symbol string, price double, ts timestamp", newest("symbol"), every)

    def rows(self, ticks: DataFrame) -> DataFrame:
        return latest(ticks)

    def write(self, rows: DataFrame, number: int) -> None:
        self.prices.put(rows, number)
        self.prices.compact(number)

    def table(self) -> DataFrame:
        return self.prices.state()


class Bars(Job):
    """Quarters of an hour, folded to days and hours of the session's zone when they are read. So a zone's
    clock can be set forward or back: an hour that comes twice is two hours, a day has 23 to 25."""

    def __init__(self, spark: SparkSession, folder: str, late: str = LATE, every: int = EVERY):
        super().__init__(spark, folder)
        self.late = late
        kept = "symbol string, quarter timestamp, last struct<ts:timestamp,event_id:bigint,price:double>, high double, low double, volume bigint"
        self.quarters = Ledger(spark, f"{self.folder}/quarters", kept, newest("symbol", "quarter"), every, self.final)

    def final(self, rows: DataFrame) -> Column:
        """Quarters that no tick changes any more: later ones of that time are dropped."""
        seen = rows.agg(F.max(F.unix_micros("last.ts")).alias("seen")).first().seen
        return F.lit(False) if seen is None else F.expr(f"quarter + INTERVAL {QUARTER} <= timestamp_micros({seen}) - INTERVAL {self.late}")

    def rows(self, ticks: DataFrame) -> DataFrame:
        return quarters(ticks, self.late)

    def write(self, rows: DataFrame, number: int) -> None:
        self.quarters.put(rows, number)
        self.quarters.compact(number)

    def daily(self) -> DataFrame:
        """(symbol, date, close, high, low, volume)"""
        days = self.quarters.state().groupBy("symbol", F.to_date("quarter").alias("date"))
        return days.agg(F.max("last").getField("price").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))

    def hourly(self) -> DataFrame:
        """(symbol, hour, price): the last price of each hour, which is the instant at which it begins."""
        hours = self.quarters.state().groupBy("symbol", F.date_trunc("hour", "quarter").alias("hour"))
        return hours.agg(F.max("last").getField("price").alias("price"))


def slot(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(SLOTS)).cast("int")


class LiveSummary(Job):
    """Portfolio summaries that change with the prices of the symbols in a batch.

    ``open`` writes the lots once, clustered by symbol, and what each portfolio invested. A batch reads the
    lots of its symbols only, adds the differences that their new prices make, per portfolio, and keeps
    the new prices; both are written by batch number, and old prices are those before the batch, so that
    a batch done again adds the same differences in the same place."""

    def __init__(self, spark: SparkSession, folder: str, every: int = EVERY):
        super().__init__(spark, folder)
        self.prices = Ledger(spark, f"{self.folder}/prices", "symbol string, price double, ts timestamp", newest("symbol"), every)
        self.values = Ledger(spark, f"{self.folder}/values", f"portfolio_id long, value {AMOUNT}", summed("portfolio_id", value="value"), every)

    def open(self, lots: DataFrame) -> LiveSummary:
        """Lots (portfolio_id, symbol, shares, purchase_price) of a new job."""
        kept = lots.select("portfolio_id", "symbol", "shares", slot(F.col("symbol")).alias("slot"))
        spread = F.pmod(F.xxhash64("portfolio_id"), F.lit(SPREAD))  # a hot symbol's lots are several files
        kept.repartition("slot", spread).sortWithinPartitions("slot", "symbol").write.partitionBy("slot").parquet(f"{self.folder}/lots")
        cost = F.coalesce(F.sum(F.col("shares") * F.col("purchase_price")), F.lit(0.0))
        lots.groupBy("portfolio_id").agg(cost.alias("invested"), F.count(F.lit(1)).alias("number_of_holdings")).write.parquet(f"{self.folder}/invested")
        return self

    def rows(self, ticks: DataFrame) -> DataFrame:
        return latest(ticks)

    def lots_of(self, slots: list[int]) -> DataFrame:
        """The lots in the given folders, at most SLOTS of them."""
        schema = "portfolio_id long, symbol string, shares double, slot int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/lots").where(F.col("slot").isin(slots))

    def changes(self, prices: DataFrame, number: int) -> DataFrame:
        """(portfolio_id, value): what the batch's prices change."""
        slots = [r.slot for r in prices.select(slot(F.col("symbol")).alias("slot")).distinct().collect()]
        before = self.prices.state(number).select("symbol", F.col("price").alias("old"))
        moved = prices.select("symbol", "price").join(before, "symbol", "left").where(~F.col("price").eqNullSafe(F.col("old")))
        worth = lambda c: F.coalesce((F.col("shares") * F.col(c)).try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
        lots = self.lots_of(slots).join(moved, "symbol")
        return lots.groupBy("portfolio_id").agg(F.sum(worth("price") - worth("old")).cast(AMOUNT).alias("value"))

    def write(self, rows: DataFrame, number: int) -> None:
        self.prices.put(rows, number)  # the query's state is worked out once, then read from here
        if number > self.values.base():
            self.values.put(self.changes(self.prices.batch(number), number), number)
        self.values.compact(number)  # the values first: where the prices have taken a batch in, they have too
        self.prices.compact(number)

    def table(self) -> DataFrame:
        """The summaries, portfolios without any price included."""
        invested = self.spark.read.parquet(f"{self.folder}/invested")
        whole = invested.join(self.values.state(), "portfolio_id", "left")
        return summary_of(whole.withColumn("current", F.coalesce(F.col("value").cast("double"), F.lit(0.0))))
