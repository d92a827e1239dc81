"""The named queries as SQL over the same tables."""

from __future__ import annotations

from lotwise.schemas import ANALYSIS_DAYS, HISTORY_DAYS, HISTORY_DEFAULT_DAYS, NO_DATA, PERIODS
from lotwise.sources.tables import VIEWS

COMMON = f"""
valued AS (SELECT l.*, price AS current_price, shares * price AS current_value, shares * price - shares * purchase_price AS gain_loss_dollars,
  (shares * price - shares * purchase_price) / nullif(shares * purchase_price, 0) * 100 AS gain_loss_percent FROM lots l LEFT JOIN latest USING (symbol)),
totals AS (SELECT portfolio_id, coalesce(sum(shares * purchase_price), 0) AS invested, coalesce(sum(current_value), 0) AS current, count(*) AS number_of_holdings FROM valued GROUP BY 1),
summary AS (SELECT portfolio_id, round_even(invested, 2) AS total_invested, round_even(current, 2) AS total_current_value,
  round_even(current - invested, 2) AS total_gain_loss_dollars,
  round_even(CASE WHEN invested > 0 THEN (current - invested) / invested * 100 ELSE 0 END, 2) AS total_gain_loss_percent, number_of_holdings FROM totals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY gain_loss_percent DESC NULLS LAST, symbol, shares, purchase_price, purchase_date) AS best,
  row_number() OVER (PARTITION BY portfolio_id ORDER BY gain_loss_percent ASC NULLS LAST, symbol, shares, purchase_price, purchase_date) AS worst FROM valued),
recent AS (SELECT b.* FROM bars b, as_of WHERE date >= day - {ANALYSIS_DAYS} AND date < day),
periods AS (SELECT unnest({list(PERIODS)}) AS days),
by_period AS (SELECT days, b.* FROM bars b, as_of, periods WHERE date >= day - days AND date < day),
series AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, max(close) OVER w AS peak, max(close) OVER w - close AS drawdown FROM recent WINDOW w AS (PARTITION BY symbol ORDER BY date)),
all_series AS (SELECT *, max(close) OVER w AS peak, max(close) OVER w - close AS drawdown FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
period_series AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, max(close) OVER w AS peak, max(close) OVER w - close AS drawdown FROM by_period WINDOW w AS (PARTITION BY days, symbol ORDER BY date)),
stats AS (SELECT symbol, stddev_samp(ret) AS sd, avg(ret) AS mean, max(drawdown) / nullif(max(peak), 0) AS mdd, max(drawdown / nullif(peak, 0)) AS mddr FROM series GROUP BY 1 HAVING count(ret) >= 1),
period_stats AS (SELECT days, symbol, stddev_samp(ret) AS sd, avg(ret) AS mean, max(drawdown) / nullif(max(peak), 0) AS mdd, max(drawdown / nullif(peak, 0)) AS mddr FROM period_series GROUP BY 1, 2 HAVING count(ret) >= 1),
positions_all AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS bars FROM recent),
aligned AS (SELECT pos, symbol, close FROM positions_all WHERE bars > 1 AND pos IN (SELECT pos FROM positions_all WHERE bars > 1 GROUP BY 1
  HAVING count(close) = (SELECT count(DISTINCT symbol) FROM positions_all WHERE bars > 1))),
held_positions AS (SELECT portfolio_id, p.* FROM positions_all p JOIN (SELECT DISTINCT portfolio_id, symbol FROM lots) USING (symbol) WHERE bars > 1),
held_aligned AS (SELECT portfolio_id, pos, symbol, close FROM held_positions QUALIFY count(close) OVER (PARTITION BY portfolio_id, pos) = sum(CAST(pos = 0 AS INT)) OVER (PARTITION BY portfolio_id)),
seen AS (SELECT b.* FROM bars b, as_of WHERE date >= day - {HISTORY_DAYS} AND date < day),
weighed AS (SELECT strategy_id, symbol, bought, CASE WHEN count(weight) OVER s = 0 THEN CASE WHEN bought THEN 1.0 / nullif(sum(CAST(bought AS INT)) OVER s, 0) END
  ELSE weight / nullif(sum(weight) OVER s, 0) END AS share FROM strategy_symbols WINDOW s AS (PARTITION BY strategy_id)),
months AS (SELECT s.*, CAST(m AS DATE) AS month, day(last_day(m)) AS length FROM strategies s, unnest(generate_series(date_trunc('month', s.start), date_trunc('month', s."end"), INTERVAL 1 MONTH)) t(m) WHERE start <= "end"),
days AS (SELECT *, month + CAST(least(day(start), min(length) OVER w) - 1 AS INT) AS cur FROM months WINDOW w AS (PARTITION BY strategy_id ORDER BY month)),
wanted AS (SELECT *, CASE WHEN purchase_day BETWEEN 1 AND length THEN month + CAST(purchase_day - 1 AS INT) ELSE cur END AS target FROM days),
stops AS (SELECT *, max(CAST(cur > "end" OR target > "end" AS INT)) OVER (PARTITION BY strategy_id ORDER BY month) AS stop FROM wanted),
schedule AS (SELECT strategy_id, month, target, monthly_amount FROM stops WHERE stop = 0),
near AS (SELECT symbol, date - CAST(off AS INT) AS target, arg_min(off, abs(off) * 100 + off) AS off, arg_min(close, abs(off) * 100 + off) AS close FROM seen, generate_series(-5, 5) o(off) GROUP BY 1, 2),
traded AS (SELECT p.strategy_id, p.month, any_value(p.target) + CAST(arg_min(n.off, abs(n.off) * 100 + n.off) AS INT) AS trade_date, any_value(p.monthly_amount) AS monthly_amount
  FROM schedule p JOIN weighed w ON w.strategy_id = p.strategy_id AND w.bought JOIN near n ON n.symbol = w.symbol AND n.target = p.target GROUP BY 1, 2),
bought AS (SELECT t.*, w.symbol, w.share, n.close AS price, CASE WHEN n.close > 0 THEN coalesce(t.monthly_amount * w.share / n.close, 0) ELSE 0 END AS bought_shares
  FROM traded t JOIN weighed w ON w.strategy_id = t.strategy_id AND w.bought LEFT JOIN near n ON n.symbol = w.symbol AND n.target = t.trade_date),
filled AS (SELECT *, sum(bought_shares) OVER (PARTITION BY strategy_id, symbol ORDER BY month) AS shares FROM bought),
monthly AS (SELECT strategy_id, month, trade_date AS date, coalesce(sum(CASE WHEN price > 0 THEN shares * price END), 0) AS value,
  row_number() OVER (PARTITION BY strategy_id ORDER BY month) * any_value(monthly_amount) AS invested FROM filled GROUP BY 1, 2, 3),
held AS (SELECT strategy_id, symbol, arg_max(shares, month) AS shares FROM filled GROUP BY 1, 2),
marks AS (SELECT h.strategy_id, coalesce(sum(CASE WHEN n.close > 0 THEN h.shares * n.close END), 0) AS final FROM held h JOIN strategies s USING (strategy_id)
  LEFT JOIN near n ON n.symbol = h.symbol AND n.target = s."end" GROUP BY 1),
done AS (SELECT strategy_id, count(DISTINCT month) AS months, max(CAST(share IS NULL AND price > 0 AS INT)) AS unweighted FROM filled GROUP BY 1),
states AS (SELECT s.*, months, final, months * monthly_amount AS invested, CASE WHEN coalesce(k.shares, 0) = 0 THEN 'weights sum to zero' WHEN months IS NULL THEN '{NO_DATA}'
  WHEN unweighted = 1 THEN 'a bought symbol has no weight' END AS error FROM strategies s LEFT JOIN done USING (strategy_id) LEFT JOIN marks USING (strategy_id)
  LEFT JOIN (SELECT strategy_id, count(share) AS shares FROM weighed GROUP BY 1) k USING (strategy_id)),
dca AS (SELECT strategy_id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN round_even(invested, 2) ELSE 0 END AS total_invested,
  CASE WHEN error IS NULL THEN round_even(final, 2) ELSE 0 END AS final_value, CASE WHEN error IS NULL THEN round_even(final - invested, 2) ELSE 0 END AS gain_loss,
  CASE WHEN error IS NULL THEN round_even(CASE WHEN invested > 0 THEN (final - invested) / invested * 100 ELSE 0 END, 2) ELSE 0 END AS gain_loss_percent,
  start AS start_date, "end" AS end_date, CAST(CASE WHEN error IS NULL THEN months ELSE 0 END AS INT) AS months_simulated FROM states),
last_close AS (SELECT symbol, arg_max(close, date) AS last FROM seen GROUP BY 1),
final_holdings AS (SELECT strategy_id, symbol, round_even(shares, 4) AS shares, round_even(coalesce(last, 0), 2) AS final_price, round_even(coalesce(shares * last, 0), 2) AS current_value FROM held LEFT JOIN last_close USING (symbol)),
tick_latest AS (SELECT symbol, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1)
"""

CENTS = """round_even(purchase_price, 2) AS purchase_price, purchase_date, round_even(current_price, 2) AS current_price, round_even(current_value, 2) AS current_value,
  round_even(gain_loss_dollars, 2) AS gain_loss_dollars, round_even(gain_loss_percent, 2) AS gain_loss_percent"""
VOLATILITY = "CASE WHEN sd > 0 THEN sd * sqrt(252) ELSE 0 END"
SHARPE = "CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END"


def pairs(source: str, key: str) -> str:
    return f"""SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, round_even(covar_pop(a.close, b.close) / nullif(stddev_pop(a.close) * stddev_pop(b.close), 0), 6) AS corr
FROM {source} a JOIN {source} b ON a.{key} = b.{key} WHERE a.close IS NOT NULL AND b.close IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"""


BODIES = {
    "holdings_csv_roundtrip": "SELECT portfolio_id, symbol, shares, round_even(purchase_price, 6) AS purchase_price, purchase_date FROM lots",
    "holdings_add": """SELECT portfolio_id, symbol, count(*) AS lots, round_even(sum(shares), 4) AS shares FROM (SELECT portfolio_id, symbol, shares FROM lots
  UNION ALL SELECT portfolio_id, min(symbol), CAST(count(*) AS DOUBLE) FROM lots GROUP BY 1) GROUP BY 1, 2""",
    "holdings_remove": "SELECT portfolio_id, count(*) AS lots, round_even(sum(shares), 4) AS shares FROM lots WHERE symbol <> 'BRAND#7' GROUP BY 1",
    "holdings_symbols": "SELECT DISTINCT symbol FROM lots",
    "price_history_period": f"SELECT symbol, date, round_even(close, 6) AS close, round_even(high, 6) AS high, round_even(low, 6) AS low, volume FROM bars, as_of WHERE date >= day - {HISTORY_DEFAULT_DAYS} AND date < day",
    "latest_price": "SELECT symbol, round_even(price, 6) AS price FROM latest",
    "latest_prices_for_holdings": "SELECT symbol, round_even(price, 6) AS price FROM latest WHERE symbol IN (SELECT symbol FROM lots)",
    "holdings_price_history": "SELECT symbol, date, round_even(close, 6) AS close FROM recent WHERE symbol IN (SELECT symbol FROM lots)",
    "security_info": """SELECT a.symbol, coalesce(name, 'N/A') AS name, coalesce(sector, 'N/A') AS sector, 'N/A' AS market_cap, 'N/A' AS pe_ratio
  FROM (SELECT DISTINCT 'P' || l_partkey AS symbol FROM lineitem UNION ALL SELECT 'S' || s_suppkey FROM supplier) a LEFT JOIN info USING (symbol)""",
    "price_trend": "SELECT symbol, date, round_even(close, 6) AS close FROM bars",
    "min_history_symbols": "SELECT symbol, count(*) AS bars FROM bars, as_of WHERE date >= day - 30 AND date < day GROUP BY 1 HAVING count(*) >= 2",
    "numeric_coercion": "SELECT event_id, round_even(TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE), 4) AS number FROM events",
    "holdings_valuation": f"SELECT portfolio_id, symbol, shares, {CENTS} FROM valued",
    "valuation_export": f"SELECT portfolio_id, symbol, shares, {CENTS} FROM valued",
    "portfolio_summary": "SELECT s.*, portfolio_name, day AS as_of_date FROM summary s LEFT JOIN portfolios USING (portfolio_id), as_of",
    "asset_allocation": """SELECT portfolio_id, symbol, purchase_date, shares, round_even(current_value, 2) AS current_value,
  round_even(current_value / nullif(sum(current_value) OVER (PARTITION BY portfolio_id), 0) * 100, 2) AS allocation_percent FROM valued""",
    "asset_allocation_by_symbol": """SELECT portfolio_id, symbol, round_even(v, 2) AS current_value, round_even(v / nullif(sum(v) OVER (PARTITION BY portfolio_id), 0) * 100, 2) AS allocation_percent
  FROM (SELECT portfolio_id, symbol, CAST(sum(CAST(current_value AS DECIMAL(28,6))) AS DOUBLE) AS v FROM valued GROUP BY 1, 2)""",
    "concentration": """SELECT portfolio_id, symbol, purchase_date, shares, round_even(p, 4) AS percent, CASE WHEN p > 30 THEN 'high' WHEN p > 20 THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT v.*, current_value / nullif(total_current_value, 0) * 100 AS p FROM valued v JOIN summary USING (portfolio_id))""",
    "invested_vs_current": """SELECT portfolio_id, symbol, round_even(CAST(sum(CAST(shares * purchase_price AS DECIMAL(28,6))) AS DOUBLE), 2) AS invested,
  round_even(CAST(sum(CAST(current_value AS DECIMAL(28,6))) AS DOUBLE), 2) AS current FROM valued GROUP BY 1, 2""",
    "gain_loss_class": "SELECT portfolio_id, CASE WHEN round_even(gain_loss_dollars, 4) > 0 THEN 'gain' ELSE 'loss' END AS class, count(*) AS lots FROM valued GROUP BY 1, 2",
    "best_performers": f"SELECT portfolio_id, symbol, shares, {CENTS}, best AS rank FROM ranked WHERE best <= 5",
    "worst_performers": f"SELECT portfolio_id, symbol, shares, {CENTS}, worst AS rank FROM ranked WHERE worst <= 5",
    "performance_ranking": f"SELECT portfolio_id, symbol, shares, {CENTS}, best AS rank FROM ranked",
    "best_worst_kpi": """SELECT portfolio_id, arg_max(symbol, (gain_loss_percent, symbol)) AS best_symbol, round_even(max(gain_loss_percent), 2) AS best_percent,
  arg_min(symbol, (gain_loss_percent, symbol)) AS worst_symbol, round_even(min(gain_loss_percent), 2) AS worst_percent FROM valued WHERE gain_loss_percent IS NOT NULL GROUP BY 1""",
    "holdings_report": """SELECT portfolio_id, symbol AS "Symbol", purchase_date AS "Bought", shares AS "Shares", round_even(current_price, 2) AS "Price", round_even(current_value, 2) AS "Value",
  round_even(gain_loss_percent, 2) AS "Gain" FROM valued""",
    "report_formatting": """SELECT portfolio_id, format('${:,.2f}', total_current_value) AS value_text, format('${:,.2f}', total_gain_loss_dollars) AS gain_text,
  format('{:.2f}%', total_gain_loss_percent) AS percent_text, CASE WHEN total_gain_loss_percent >= 0 THEN '+' ELSE '' END || format('{:.2f}', total_gain_loss_percent) AS signed_text,
  format('${:,.0f}', round_even(total_current_value, 0)) AS whole_text, format('{:.1f}%', round_even(total_gain_loss_percent / 100 * 100, 1)) AS tenth_text,
  format('{:.2f}%', round_even(total_gain_loss_percent / 100 * 100, 2)) AS fraction_text FROM summary""",
    "report_timestamps": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_text, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text,
  CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events""",
    "portfolio_snapshot_json": """SELECT portfolio_id, '2002-01-01 09:30:00' AS datetime, CAST(1009877400 AS BIGINT) AS timestamp, portfolio_name, total_current_value, number_of_holdings, number_of_holdings AS lots,
  (SELECT min(symbol) FROM lots l WHERE l.portfolio_id = s.portfolio_id) AS first_symbol FROM summary s LEFT JOIN portfolios USING (portfolio_id)""",
    "portfolio_history_rows": """SELECT portfolio_id, symbol AS stock_symbol, purchase_date, shares, round_even(current_price, 2) AS current_price, round_even(current_value, 2) AS current_value,
  round_even(gain_loss_dollars, 2) AS gain_loss_dollars, round_even(gain_loss_percent, 2) AS gain_loss_percent, total_current_value AS total_portfolio_value, total_gain_loss_percent AS total_return_percent, '2002-01-01 09:30:00' AS taken
  FROM valued JOIN summary USING (portfolio_id)""",
    "snapshot_totals": "SELECT portfolio_id, DATE '2002-01-01' AS date, total_current_value AS total_value, total_gain_loss_percent AS return_pct FROM summary",
    "recent_history": """SELECT portfolio_id, symbol AS stock_symbol, purchase_date, shares, round_even(current_value, 2) AS current_value, '2002-01-02 09:30:00' AS taken FROM valued
  ORDER BY portfolio_id, symbol, purchase_date, shares, round_even(current_value, 2) LIMIT 100""",
    "daily_returns": "SELECT symbol, date, round_even(ret, 8) AS ret FROM series",
    "running_peak": "SELECT symbol, date, round_even(peak, 6) AS peak FROM all_series",
    "drawdown_series": "SELECT symbol, date, round_even(drawdown, 6) AS drawdown FROM all_series",
    "risk_metrics": f"SELECT symbol, round_even({VOLATILITY}, 6) AS volatility, round_even({SHARPE}, 6) AS sharpe_ratio, round_even(mdd, 6) AS max_drawdown, round_even(mean * 252, 6) AS avg_return FROM stats",
    "volatility": "SELECT symbol, round_even(sd * sqrt(252), 6) AS volatility FROM stats",
    "sharpe_ratio": f"SELECT symbol, round_even({SHARPE}, 6) AS sharpe_ratio FROM stats",
    "max_drawdown": "SELECT symbol, round_even(mdd, 6) AS max_drawdown FROM stats",
    "max_drawdown_relative": "SELECT symbol, round_even(mddr, 6) AS max_drawdown_relative FROM stats",
    "avg_return": "SELECT symbol, round_even(mean * 252, 6) AS avg_return FROM stats",
    "risk_by_period": f"""SELECT CAST(days AS INT) AS days, symbol, round_even({VOLATILITY}, 6) AS volatility, round_even({SHARPE}, 6) AS sharpe_ratio, round_even(mdd, 6) AS max_drawdown,
  round_even(mddr, 6) AS max_drawdown_relative, round_even(mean * 252, 6) AS avg_return FROM period_stats""",
    "risk_more_metrics": f"""SELECT symbol, round_even({VOLATILITY}, 6) AS volatility, round_even({SHARPE}, 6) AS sharpe_ratio, round_even(below * sqrt(252), 6) AS downside_volatility,
  round_even(best, 6) AS best_day, round_even(worst, 6) AS worst_day, round_even(CAST(gains AS DOUBLE) / days, 6) AS share_of_gains FROM stats
  JOIN (SELECT symbol, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS below, max(ret) AS best, min(ret) AS worst, count(CASE WHEN ret > 0 THEN 1 END) AS gains, count(ret) AS days FROM series GROUP BY 1) USING (symbol)""",
    "risk_report": f"""SELECT symbol AS "Symbol", format('{{:.2f}}%', round_even({VOLATILITY} * 100, 2)) AS "Volatility", format('{{:.2f}}', round_even({SHARPE}, 2)) AS "Sharpe",
  format('{{:.2f}}%', round_even(mdd * 100, 2)) AS "Drawdown", format('{{:.2f}}%', round_even(mean * 252 * 100, 2)) AS "Return" FROM stats""",
    "price_positional_align": "SELECT CAST(pos AS INT) AS pos, symbol, round_even(close, 6) AS close FROM aligned",
    "correlation_matrix": pairs("aligned", "pos"),
    "correlation_by_date": pairs("recent", "date"),
    "holdings_risk": f"""SELECT portfolio_id, symbol, round_even({VOLATILITY}, 6) AS volatility, round_even({SHARPE}, 6) AS sharpe_ratio, round_even(mdd, 6) AS max_drawdown,
  round_even(mddr, 6) AS max_drawdown_relative, round_even(mean * 252, 6) AS avg_return FROM stats JOIN (SELECT DISTINCT portfolio_id, symbol FROM lots) USING (symbol)""",
    "holdings_correlation": """SELECT a.portfolio_id, a.symbol AS symbol_a, b.symbol AS symbol_b, round_even(covar_pop(a.close, b.close) / nullif(stddev_pop(a.close) * stddev_pop(b.close), 0), 6) AS corr
  FROM held_aligned a JOIN held_aligned b ON a.portfolio_id = b.portfolio_id AND a.pos = b.pos GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "dca_holdings_map": """SELECT strategy_id, month, '{' || string_agg('"' || symbol || '":' || CAST(CAST(round_even(shares, 4) AS DECIMAL(18,4)) AS VARCHAR), ',' ORDER BY symbol) || '}' AS holdings,
  CAST(count(*) AS INT) AS symbols FROM filled GROUP BY 1, 2""",
    "dca_monthly_nested": """SELECT strategy_id, CAST(count(*) AS INT) AS months, '[' || string_agg('{"date":"' || date || '","total_invested":' || CAST(CAST(round_even(invested, 2) AS DECIMAL(18,2)) AS VARCHAR)
  || ',"portfolio_value":' || CAST(CAST(round_even(value, 2) AS DECIMAL(18,2)) AS VARCHAR) || ',"gain_loss":' || CAST(CAST(round_even(value - invested, 2) AS DECIMAL(18,2)) AS VARCHAR) || '}', ',' ORDER BY date) || ']' AS monthly_data
  FROM monthly GROUP BY 1""",
    "dca_equal_weights": "SELECT strategy_id, symbol, bought, round_even(CASE WHEN bought THEN 1.0 / nullif(sum(CAST(bought AS INT)) OVER (PARTITION BY strategy_id), 0) END, 6) AS share FROM strategy_symbols",
    "dca_normalized_weights": "SELECT strategy_id, symbol, bought, round_even(share, 6) AS share FROM weighed",
    "dca_strategy_validation": """SELECT strategy_id, r IS NULL AS valid, coalesce(r, '') AS reason FROM (SELECT strategy_id, CASE WHEN start >= "end" THEN 'start must be before end'
  WHEN w < 0.99 THEN 'weights must sum to 1' WHEN monthly_amount NOT BETWEEN 100 AND 100000 THEN 'amount out of range' END AS r
  FROM strategies LEFT JOIN (SELECT strategy_id, sum(weight) AS w FROM strategy_symbols GROUP BY 1) USING (strategy_id))""",
    "dca_schedule": "SELECT strategy_id, month, target FROM schedule",
    "dca_trade_dates": "SELECT strategy_id, month, trade_date FROM traded",
    "asof_nearest_price": """SELECT symbol, target, target + CAST(off AS INT) AS found, round_even(close, 6) AS price FROM (SELECT DISTINCT symbol, purchase_date AS target FROM lots) LEFT JOIN near USING (symbol, target)""",
    "dca_fills": "SELECT strategy_id, month, symbol, round_even(price, 4) AS price, round_even(bought_shares, 6) AS bought_shares FROM filled",
    "dca_cumulative_shares": "SELECT strategy_id, month, symbol, round_even(shares, 6) AS shares FROM filled",
    "dca_monthly": "SELECT strategy_id, month, date, round_even(invested, 2) AS total_invested, round_even(value, 2) AS portfolio_value, round_even(value - invested, 2) AS gain_loss FROM monthly",
    "dca_summary": "SELECT * FROM dca",
    "dca_reported_errors": """SELECT strategy_id, CASE WHEN error = 'No trading data found for selected period' THEN error ELSE 'Simulation error: ' || left(error, 200) END AS error
  FROM dca WHERE NOT success""",
    "dca_holdings_final": "SELECT * FROM final_holdings",
    "dca_final_allocation": "SELECT strategy_id, symbol, round_even(current_value / nullif(sum(current_value) OVER (PARTITION BY strategy_id), 0) * 100, 4) AS percent FROM final_holdings",
    "dca_monthly_average": "SELECT strategy_id, round_even(total_invested / nullif(months_simulated, 0), 2) AS average FROM dca",
    "dca_vs_actual": """SELECT strategy_id AS id, 'simulated' AS type, total_invested AS invested, final_value AS current, gain_loss_percent AS percent FROM dca WHERE success
  UNION ALL SELECT portfolio_id, 'actual', total_invested, total_current_value, total_gain_loss_percent FROM summary""",
    "stream_latest_price": "SELECT * FROM tick_latest",
    "stream_portfolio_summary": """SELECT portfolio_id, round_even(i, 2) AS total_invested, round_even(c, 2) AS total_current_value, round_even(c - i, 2) AS total_gain_loss_dollars,
  round_even(CASE WHEN i > 0 THEN (c - i) / i * 100 ELSE 0 END, 2) AS total_gain_loss_percent, number_of_holdings
  FROM (SELECT portfolio_id, coalesce(sum(shares * purchase_price), 0) AS i, coalesce(sum(shares * price), 0) AS c, count(*) AS number_of_holdings FROM tick_lots LEFT JOIN tick_latest USING (symbol) GROUP BY 1)""",
    "stream_daily_bars": "SELECT symbol, CAST(ts AS DATE) AS date, arg_max(price, (ts, event_id)) AS close, max(price) AS high, min(price) AS low, count(price) AS volume FROM ticks GROUP BY 1, 2",
    "stream_hourly_snapshot": "SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1, 2",
}

ORACLE = {name: f"WITH {VIEWS.strip()},{COMMON}{body}" for name, body in BODIES.items()}
