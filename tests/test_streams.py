"""Streams over several files, out of order, in a session that is not in UTC; scratch tables."""

import datetime
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lotwise.operators import valuation
from lotwise.schemas import EVENTS
from lotwise.sources import storage
from lotwise.streaming import ticks as streams

ROWS = [  # event_id, local time, symbol, price
    (1, "2024-03-01 23:30:00", 1, 10.0),
    (2, "2024-03-02 00:10:00", 1, 11.0),
    (3, "2024-03-02 12:00:00", 1, 9.0),
    (4, "2024-03-02 12:00:00", 1, 9.5),
    (5, "2024-03-01 22:00:00", 1, 12.0),  # late by less than a day
    (6, "2024-03-02 23:59:59", 2, None),
    (7, "2024-03-03 00:00:00", 2, 5.0),
]


@pytest.fixture(params=["UTC", "Asia/Kolkata", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.fixture
def folder(spark, tmp_path):
    for k, part in enumerate((ROWS[2:4], ROWS[:2], ROWS[4:])):
        rows = [(i, datetime.datetime.fromisoformat(t), u, "buy", p, None) for i, t, u, p in part]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            f.rename(tmp_path / f"events-{k}.parquet")
    return str(tmp_path)


def read(spark, folder):
    return streams.read_ticks(spark, folder, "events-*.parquet", files=1)


def test_days_and_hours_of_the_session(spark, folder, zone, tmp_path):
    job = streams.Bars(spark, str(tmp_path / "job"))
    job.drain(read(spark, folder))
    assert sorted((r.symbol, str(r.date), r.close, r.high, r.low, r.volume) for r in job.daily().collect()) == [
        ("U1", "2024-03-01", 10.0, 12.0, 10.0, 2),
        ("U1", "2024-03-02", 9.5, 11.0, 9.0, 3),
        ("U2", "2024-03-02", None, None, None, 0),
        ("U2", "2024-03-03", 5.0, 5.0, 5.0, 1),
    ]
    got = {(r.symbol, r.hour): r.price for r in job.hourly().selectExpr("symbol", "date_format(hour, 'dd HH:mm') AS hour", "price").collect()}
    assert got == {("U1", "01 23:00"): 10.0, ("U1", "02 00:00"): 11.0, ("U1", "02 12:00"): 9.5, ("U1", "01 22:00"): 12.0, ("U2", "02 23:00"): None, ("U2", "03 00:00"): 5.0}


CLOCKS = [  # instants around the two changes of New York's clock
    (1, "2023-11-05T05:30:00+00:00", 1, 1.0),  # 01:30, the first time
    (2, "2023-11-05T06:30:00+00:00", 1, 2.0),  # 01:30 again
    (3, "2023-11-05T07:10:00+00:00", 1, 3.0),  # 02:10
    (4, "2023-11-05T04:59:59+00:00", 1, 4.0),  # 00:59:59 on the same day
    (5, "2023-11-05T03:59:59+00:00", 1, 5.0),  # the day before
    (6, "2024-03-10T06:59:00+00:00", 1, 6.0),  # 01:59, then 02:00 doesn't come
    (7, "2024-03-10T07:00:00+00:00", 1, 7.0),  # 03:00
    (8, "2024-03-10T04:30:00+00:00", 1, 8.0),  # 23:30 on the day before
]


def test_hours_and_days_where_clocks_change(spark, tmp_path, zone):
    job = streams.Bars(spark, str(tmp_path / "job"), late="1000 days")
    rows = spark.createDataFrame([(i, "S1", int(datetime.datetime.fromisoformat(t).timestamp() * 1_000_000), p) for i, t, _, p in CLOCKS], "event_id long, symbol string, micros long, price double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job.drain(stream.selectExpr("symbol", "timestamp_micros(micros) AS ts", "price", "event_id"))
    hours, days = {}, {}
    for i, t, _, p in sorted(CLOCKS, key=lambda r: r[1]):
        at = datetime.datetime.fromisoformat(t).astimezone(ZoneInfo(zone))
        second = int(at.timestamp())
        hours[second - (second + int(at.utcoffset().total_seconds())) % 3600] = p
        close, volume = days.get(str(at.date()), (None, 0))
        days[str(at.date())] = (p, volume + 1)
    assert {r.at: r.price for r in job.hourly().selectExpr("unix_seconds(hour) AS at", "price").collect()} == hours
    assert {str(r.date): (r.close, r.volume) for r in job.daily().collect()} == days
    if zone == "America/New_York":
        assert len(hours) == 8


def test_latest_over_files(spark, folder, tmp_path):
    job = streams.LatestPrices(spark, str(tmp_path / "job"))
    job.drain(read(spark, folder))
    assert {r.symbol: r.price for r in job.table().collect()} == {"U1": 9.5, "U2": 5.0}


def tick_file(spark, folder, number, rows):
    """One more file of (event_id, seconds, symbol, price)."""
    frame = spark.createDataFrame(rows, "event_id long, second long, symbol string, price double")
    frame.coalesce(1).write.parquet(f"{folder}/new-{number}")
    (part,) = (folder / f"new-{number}").glob("part-*")
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"ticks-{number:03d}.parquet")


def tick_stream(spark, folder):
    rows = spark.readStream.schema("event_id long, second long, symbol string, price double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return rows.selectExpr("symbol", "timestamp_seconds(second) AS ts", "price", "event_id")


def test_stopped_and_started_again(spark, tmp_path):
    """A job that is stopped between files and goes on from its folder leaves what one run leaves."""
    one, two = tmp_path / "one", tmp_path / "two"
    for number in range(4):
        tick_file(spark, tmp_path, number, [(10 * number + k, 900 * ((7 * number + k) % 9), f"S{k % 3}", float(number + k)) for k in range(6)])
        streams.Bars(spark, str(two / "bars")).drain(tick_stream(spark, tmp_path))
        job = streams.LatestPrices(spark, str(two / "latest"))
        job.drain(tick_stream(spark, tmp_path))
    whole = streams.Bars(spark, str(one / "bars"))
    whole.drain(tick_stream(spark, tmp_path))
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(whole.hourly()) == key(streams.Bars(spark, str(two / "bars")).hourly())
    assert key(whole.daily()) == key(streams.Bars(spark, str(two / "bars")).daily())
    latest = streams.LatestPrices(spark, str(one / "latest"))
    latest.drain(tick_stream(spark, tmp_path))
    assert key(latest.table()) == key(job.table()) and len(job.prices.numbers("batch")) == 4


def test_running_refresh(spark, tmp_path):
    """With a time between batches the query goes on until its handle stops it."""
    tick_file(spark, tmp_path, 0, [(1, 0, "A", 1.0)])
    job = streams.LatestPrices(spark, str(tmp_path / "job"))
    query = job.start(tick_stream(spark, tmp_path), every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive and [r.price for r in job.table().collect()] == [1.0]
        tick_file(spark, tmp_path, 1, [(2, 5, "A", 2.0)])
        query.processAllAvailable()
        assert [r.price for r in job.table().collect()] == [2.0]
    finally:
        query.stop()
    assert not query.isActive


def test_a_batch_counts_once(spark, tmp_path):
    schema = "symbol string, price double, ts timestamp"
    now = datetime.datetime(2024, 1, 1)
    job = streams.LatestPrices(spark, str(tmp_path / "latest"), every=2)
    bars = streams.Bars(spark, str(tmp_path / "bars"))
    kept = bars.quarters.schema
    for number in range(5):
        for _ in range(2):  # each batch is done twice
            job.write(spark.createDataFrame([("A", float(number), now), (f"B{number}", 1.0, now)], schema), number)
            bars.write(spark.createDataFrame([("A", now + datetime.timedelta(hours=number), (now, number, float(number)), 1.0, 1.0, 3)], kept), number)
    assert {r.symbol: r.price for r in job.table().collect()} == {"A": 4.0} | {f"B{k}": 1.0 for k in range(5)}
    assert bars.daily().collect()[0].volume == 15 and bars.hourly().count() == 5


def test_ledgers_stay_small(spark, tmp_path):
    """However many batches there are, the state is one base and a few batches, and the same."""
    schema = "symbol string, price double, ts timestamp"
    job = streams.LatestPrices(spark, str(tmp_path / "latest"), every=4)
    want = {}
    for number in range(30):
        rows = [(f"S{(number * 5 + k) % 11}", float(number), datetime.datetime(2024, 1, 1)) for k in range(3)]
        want |= {s: p for s, p, _ in rows}
        job.write(spark.createDataFrame(rows, schema).coalesce(1), number)
        assert len(job.prices.numbers("base")) <= 2 and len(job.prices.numbers("batch")) <= 8 and len(job.prices.paths()) <= 4
    assert {r.symbol: r.price for r in job.table().collect()} == want
    (tmp_path / "latest/prices/batch=30").mkdir()  # a batch that did not end
    assert {r.symbol: r.price for r in job.table().collect()} == want


def test_final_quarters_leave_the_base(spark, tmp_path):
    """A long history is the same whether it is compacted often or never, and its base only holds the last day."""
    rng = random.Random(11)
    for number in range(9):  # ticks of a day and a half each, out of order, some late by less than a day
        rows = [(100 * number + k, 86_400 * number + rng.randrange(0, 120_000), f"S{k % 3}", float(rng.randrange(99))) for k in range(25)]
        tick_file(spark, tmp_path, number, rows)
    often, never = streams.Bars(spark, str(tmp_path / "often"), every=2), streams.Bars(spark, str(tmp_path / "never"), every=10**6)
    for job in (often, never):
        job.drain(tick_stream(spark, tmp_path))
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert key(often.hourly()) == key(never.hourly()) and key(often.daily()) == key(never.daily())
    assert often.quarters.numbers("final") and not never.quarters.numbers("base")
    assert often.quarters.changing().count() < 0.6 * never.quarters.state().count()
    for batch in (7, 8):  # done again after a failure
        often.write(never.quarters.batch(batch), batch)
    assert key(often.hourly()) == key(never.hourly())


def test_summaries_change_by_differences(spark, tmp_path):
    """After every batch the kept summaries are those of a revaluation of all lots."""
    rng = random.Random(5)
    rows = [(rng.randrange(9), f"S{rng.choice([0, 0, 0, 1, 2, 3, 4, 99])}", float(rng.randrange(1, 50)), 2.5) for _ in range(300)] + [(77, "NONE", 1.0, 4.0), (78, None, 2.0, None)]
    lots = spark.createDataFrame(rows, "portfolio_id long, symbol string, shares double, purchase_price double").withColumn("purchase_date", F.lit(None).cast("date"))
    job = streams.LiveSummary(spark, str(tmp_path / "job"), every=3).open(lots)
    prices = {}
    batches = [[("S0", 3.0), ("S1", 1.25)], [("S0", 3.5), ("S7", 9.0)], [("S1", None), ("S2", 2.0)], [("S3", 4.0), ("S0", None)], [("S0", 1.0), ("S1", 8.0)]]
    for number, batch in enumerate(batches):
        prices |= dict(batch)
        frame = spark.createDataFrame([(s, p, datetime.datetime(2024, 1, 1)) for s, p in batch], "symbol string, price double, ts timestamp")
        for _ in range(2):  # done again after a failure
            job.write(frame, number)
        whole = valuation.summarize(valuation.value_lots(lots, spark.createDataFrame(list(prices.items()), "symbol string, price double")))
        assert sorted(map(tuple, job.table().collect())) == sorted(map(tuple, whole.collect()))
    # a batch reads the folders of its symbols only
    read_slots = [r.s for r in spark.createDataFrame([("S3",)], "symbol string").select(streams.slot(F.col("symbol")).alias("s")).collect()]
    assert {r.f.split("/")[-2] for r in job.lots_of(read_slots).select(F.input_file_name().alias("f")).distinct().collect()} == {f"slot={read_slots[0]}"}


def test_summary_stream(spark, tmp_path):
    """The same through a stream that is stopped and goes on."""
    lots = spark.createDataFrame([(k % 5, f"S{k % 3}", 1.0 + k, 2.0) for k in range(40)], "portfolio_id long, symbol string, shares double, purchase_price double").withColumn("purchase_date", F.lit(None).cast("date"))
    job = streams.LiveSummary(spark, str(tmp_path / "job")).open(lots)
    prices = {}
    for number in range(3):
        rows = [(10 * number + k, 10 * number + k, f"S{k % (number + 1)}", float(number * k + 1)) for k in range(4)]
        prices |= {s: p for _, _, s, p in rows}
        tick_file(spark, tmp_path, number, rows)
        streams.LiveSummary(spark, str(tmp_path / "job")).drain(tick_stream(spark, tmp_path))
        whole = valuation.summarize(valuation.value_lots(lots, spark.createDataFrame(list(prices.items()), "symbol string, price double")))
        assert sorted(map(tuple, job.table().collect())) == sorted(map(tuple, whole.collect()))


def test_scratch_tables_go(spark):
    with storage.scratch():
        with storage.scratch():
            inner, kept = storage.stored(spark.range(3), "inner"), storage.outlive(storage.stored(spark.range(5), "kept"))
        assert kept.count() == 5
        with pytest.raises(Exception):
            inner.count()
    old = storage.stored(spark.range(2), "old")
    assert storage.expire(spark, 1) == 0 and old.count() == 2
    assert storage.expire(spark, 0) >= 1
    with pytest.raises(Exception):
        old.count()
