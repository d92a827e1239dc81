import datetime

import pytest

from lotwise.operators import holdings, valuation
from lotwise.schemas import HOLDINGS
from lotwise.sources import files

DAY = datetime.date(2023, 1, 15)
PRICES = "symbol string, price double"


def lots(spark, *rows):
    return spark.createDataFrame([(p, s, n, c, DAY) for p, s, n, c in rows], HOLDINGS)


def test_four_lot_portfolio(spark):
    held = lots(spark, (1, "AAPL", 10.0, 150.0), (1, "MSFT", 5.0, 300.0), (1, "GOOGL", 3.0, 2800.0), (1, "AMZN", 2.0, 3200.0))
    prices = spark.createDataFrame([("AAPL", 252.89), ("MSFT", 365.97), ("GOOGL", 280.92), ("AMZN", 207.54)], PRICES)
    valued = valuation.value_lots(held, prices)
    s = valuation.summarize(valued).first()
    assert (s.total_invested, s.total_current_value, s.total_gain_loss_dollars, s.total_gain_loss_percent, s.number_of_holdings) == (17800.0, 5616.59, -12183.41, -68.45, 4)
    gains = {r.symbol: round(r.gain_loss_percent, 2) for r in valued.collect()}
    assert gains == {"AAPL": 68.59, "MSFT": 21.99, "GOOGL": -89.97, "AMZN": -93.51}
    assert sum(r.allocation_percent for r in valuation.allocate(valued).collect()) == pytest.approx(100, abs=0.03)
    assert [r.symbol for r in valuation.performers(valued, 2).orderBy("rank").collect()] == ["AAPL", "MSFT"]
    assert [r.symbol for r in valuation.performers(valued, 2, best=False).orderBy("rank").collect()] == ["AMZN", "GOOGL"]
    k = valuation.extremes(valued).first()
    assert (k.best_symbol, k.worst_symbol) == ("AAPL", "AMZN")


def test_lots_without_price_and_without_cost(spark):
    held = lots(spark, (1, "A", 1.0, 10.0), (1, "B", 1.0, 10.0), (2, "B", 2.0, 5.0), (3, "A", 1.0, 0.0))
    valued = valuation.value_lots(held, spark.createDataFrame([("A", 12.0)], PRICES))
    rows = {(r.portfolio_id, r.symbol): r for r in valued.collect()}
    assert rows[1, "B"].current_value is None and rows[1, "B"].gain_loss_dollars is None
    assert rows[3, "A"].gain_loss_percent is None
    sums = {r.portfolio_id: r for r in valuation.summarize(valued).collect()}
    assert sums[1].total_invested == 20.0 and sums[1].total_current_value == 12.0
    assert sums[2].total_current_value == 0.0 and sums[2].total_gain_loss_percent == -100.0
    assert sums[3].total_gain_loss_percent == 0.0


def test_duplicate_lots_add_and_remove(spark):
    held = holdings.add(lots(spark, (1, "A", 1.0, 10.0), (1, "A", 1.0, 10.0)), lots(spark, (1, "b", 1.0, 1.0)))
    assert sorted(r.symbol for r in held.collect()) == ["A", "A", "B"]
    assert [r.symbol for r in holdings.remove(held, "a").collect()] == ["B"]
    assert holdings.symbols(held).count() == 2


def test_empty_holdings(spark):
    none = spark.createDataFrame([], HOLDINGS)
    valued = valuation.value_lots(none, spark.createDataFrame([], PRICES))
    assert valuation.summarize(valued).count() == 0 and valuation.allocate(valued).count() == 0


def test_csv_round_trip_and_history(spark, tmp_path):
    held = lots(spark, (1, "aapl", 10.0, 150.0), (1, "MSFT", 5.5, 300.25))
    files.write_holdings(held, str(tmp_path / "h"))
    back = {r.symbol: r for r in files.read_holdings(spark, str(tmp_path / "h")).collect()}
    assert set(back) == {"AAPL", "MSFT"} and back["MSFT"].shares == 5.5 and back["MSFT"].purchase_date == DAY
    valued = valuation.value_lots(held, spark.createDataFrame([("MSFT", 310.0)], PRICES))
    for k in (1, 2):
        taken = datetime.datetime(2024, 1, k, 12)
        files.append_history(files.history_rows(valued, valuation.summarize(valued), taken), str(tmp_path / "log"))
    rows = files.recent_history(spark, str(tmp_path / "log"), datetime.date(2024, 1, 1), 3).collect()
    assert [r.timestamp.day for r in rows] == [2, 2, 1]
    document = files.snapshot_documents(valued, valuation.summarize(valued), datetime.datetime(2024, 1, 1)).first().document
    assert '"timestamp":1704067200' in document and '"number_of_holdings":2' in document


def test_unknown_security_is_not_available(spark):
    info = spark.createDataFrame([("A", "Alpha", None, None, None)], "symbol string, name string, sector string, market_cap double, pe_ratio double")
    rows = {r.symbol: r for r in valuation.with_info(spark.createDataFrame([("A",), ("Z",)], "symbol string"), info).collect()}
    assert (rows["A"].name, rows["A"].sector, rows["Z"].name, rows["Z"].pe_ratio) == ("Alpha", "N/A", "N/A", "N/A")


def test_recent_history_reads_the_newest_days_only(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in range(1, 21):
        rows = [(p, datetime.datetime(2024, 1, day, 9 + p), "A", None, 1.0, float(day)) for p in range(3)]
        frame = spark.createDataFrame(rows, "portfolio_id long, timestamp timestamp, stock_symbol string, purchase_date date, shares double, current_value double")
        files.append_history(frame.coalesce(1), path)
    out = files.recent_history(spark, path, datetime.date(2024, 1, 3), 7)
    assert [(r.portfolio_id, r.current_value) for r in out.collect()] == [(2, 20.0), (1, 20.0), (0, 20.0), (2, 19.0), (1, 19.0), (0, 19.0), (2, 18.0)]
    days = {f.split("snapshot_date=")[1][:10] for f in out.inputFiles()}
    assert days == {"2024-01-20", "2024-01-19", "2024-01-18"}
    assert files.recent_history(spark, path, datetime.date(2024, 1, 20), 50).count() == 3
    assert files.recent_history(spark, path, datetime.date(2024, 2, 1), 50).count() == 0
