import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import asof, correlation, returns, risk
from lotwise.schemas import BARS

FIRST = datetime.date(2024, 1, 1)


def bars(spark, **series):
    rows = []
    for symbol, closes in series.items():
        rows += [(symbol, FIRST + datetime.timedelta(days=k), c, c, c, 1.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def test_drawdowns_and_short_series(spark):
    out = {r.symbol: r for r in risk.measure(bars(spark, X=[100.0, 120.0, 60.0, 110.0], Y=[100.0, 50.0, 200.0], ONE=[5.0], TWO=[5.0, 6.0]), ["symbol"]).collect()}
    assert (out["X"].max_drawdown, out["X"].max_drawdown_relative) == (0.5, 0.5)
    assert (out["Y"].max_drawdown, out["Y"].max_drawdown_relative) == (0.25, 0.5)
    assert "ONE" not in out
    assert (out["TWO"].volatility, out["TWO"].sharpe_ratio, out["TWO"].raw_volatility) == (0.0, 0.0, None)
    assert out["TWO"].avg_return == pytest.approx(0.2 * 252)
    ret = [0.2, -0.5, 110 / 60 - 1]
    mean = sum(ret) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in ret) / 2)
    assert out["X"].volatility == pytest.approx(sd * math.sqrt(252)) and out["X"].sharpe_ratio == pytest.approx(mean / sd * math.sqrt(252))


def test_a_metric_of_ones_own(spark):
    risk.register("second_best", lambda a: F.get(a["best"], F.lit(1)), best=lambda: F.sort_array(F.collect_list("ret"), asc=False))
    try:
        table = bars(spark, X=[100.0, 120.0, 60.0, 110.0], TWO=[5.0, 6.0])
        plain, more = risk.measure(table, ["symbol"]), risk.measure(table, ["symbol"], ("second_best",))
        assert {r.symbol: r.second_best for r in more.collect()} == {"X": pytest.approx(0.2), "TWO": None}
        assert sorted(map(tuple, more.drop("second_best").collect())) == sorted(map(tuple, plain.collect()))
        count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        assert count(risk.measure(table, ["symbol"], ("second_best",))) == count(risk.measure(table, ["symbol"])) == 1
        with pytest.raises(ValueError):
            risk.register("volatility", lambda a: a["x"], x=lambda: F.max("ret"))
        with pytest.raises(KeyError):
            risk.measure(table, ["symbol"], ("no such",))
    finally:
        del risk.METRICS["second_best"]


def test_missing_close_is_carried_forward(spark):
    rows = returns.with_returns(bars(spark, A=[1.0, None, 2.0, 4.0]), ["symbol"]).orderBy("date").collect()
    assert [r.ret for r in rows] == [None, 0.0, 1.0, 1.0]


def test_periods_share_one_scan(spark):
    as_of = FIRST + datetime.timedelta(days=40)
    rows = returns.by_period(bars(spark, A=[float(k + 1) for k in range(40)]), as_of, (7, 30, 365))
    assert {r.days: r["count"] for r in rows.groupBy("days").count().collect()} == {7: 7, 30: 30, 365: 40}


def test_alignment_by_position(spark):
    aligned = correlation.align_by_position(bars(spark, A=[1.0, 2.0, 3.0], B=[9.0, 8.0], C=[4.0]))
    assert sorted((r.pos, r.symbol, r.close) for r in aligned.collect()) == [(0, "A", 1.0), (0, "B", 9.0), (1, "A", 2.0), (1, "B", 8.0)]
    corr = {(r.symbol_a, r.symbol_b): r["corr"] for r in correlation.correlate(aligned, "pos").collect()}
    assert corr["A", "B"] == pytest.approx(-1) and corr["B", "A"] == corr["A", "B"] and corr["A", "A"] == pytest.approx(1)


def by_hand(closes, symbols):
    """Correlations among the symbols that have more than one bar, over positions at which all have a close."""
    symbols = [s for s in symbols if len(closes.get(s, [])) > 1]
    longest = max((len(closes[s]) for s in symbols), default=0)
    full = [k for k in range(longest) if all(k < len(closes[s]) and closes[s][k] is not None for s in symbols)]
    out = {}
    for a in symbols:
        for b in symbols:
            x, y = ([closes[s][k] for k in full] for s in (a, b))
            if len(full) >= 2:
                mx, my = sum(x) / len(x), sum(y) / len(y)
                below = math.sqrt(sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y))
                out[a, b] = sum((v - mx) * (w - my) for v, w in zip(x, y)) / below if below else None
    return out


def test_correlation_within_portfolios(spark):
    rng = random.Random(6)
    closes = {f"S{k}": [rng.choice([None, 2.0, 3.0, 5.0, 8.0]) if k % 3 == 0 else float(rng.randrange(1, 50)) for _ in range(rng.choice([2, 63, 64, 65, 130, 200]))] for k in range(12)}
    closes |= {"ONE": [4.0], "FLAT": [7.0] * 150, "TWO": [None, 1.0, 2.0], "GAPS": [1.0, None] * 100, "OTHER": [None, 1.0] * 100}
    held = {k: rng.sample(sorted(closes), rng.randrange(1, 7)) + ["NOT THERE"] for k in range(40)} | {90: ["GAPS", "OTHER"], 91: ["ONE"], 92: ["S1", "ONE"]}
    rows = [(k, s) for k, symbols in held.items() for s in symbols * 2]
    got = correlation.correlate_held(spark.createDataFrame(rows, "portfolio_id long, symbol string"), bars(spark, **closes)).collect()
    found = {(r.portfolio_id, r.symbol_a, r.symbol_b): r["corr"] for r in got}
    want = {(k, *pair): c for k, symbols in held.items() for pair, c in by_hand(closes, symbols).items()}
    assert len(got) == len(found) and found.keys() == want.keys() and len(found) > 100
    assert all((found[k] is None) == (c is None) and (c is None or found[k] == pytest.approx(c, abs=1e-9)) for k, c in want.items())


def test_constant_series_has_no_correlation(spark):
    rows = correlation.correlate(bars(spark, A=[1.0, 1.0, 1.0], B=[1.0, 2.0, 3.0]), "date").collect()
    assert {(r.symbol_a, r.symbol_b): r["corr"] for r in rows}["A", "B"] is None


def test_nearest_bar_prefers_the_earlier_and_keeps_gaps(spark):
    table = spark.createDataFrame([("A", FIRST, 1.0), ("A", FIRST + datetime.timedelta(days=2), 3.0), ("B", FIRST, None), ("B", FIRST + datetime.timedelta(days=1), 2.0)], "symbol string, date date, close double")
    near = {(r.symbol, (r.target - FIRST).days): (r.off, r.close) for r in asof.nearest_bars(table).collect()}
    assert near["A", 1] == (-1, 1.0) and near["A", 7] == (-5, 3.0) and ("A", 8) not in near
    assert near["B", 0] == (0, None)
