"""DuckDB SQL for the queries: common table expressions by name, put together as far as each query needs them."""

from __future__ import annotations

import re

from panelforge.operators.backtest import TRADING_DAYS
from panelforge.operators.folds import EMBARGO, INITIAL, N_FOLDS
from panelforge.operators.model import FIXED
from panelforge.schemas import DECLARED, FEATURES, LABELS

_F, _L = ", ".join(FEATURES), ", ".join(LABELS)


def _linear(p: str) -> str:
    b, *rest = FIXED[p]
    return f"round(1 / (1 + exp(-(CAST({b} AS DOUBLE) " + " ".join(f"+ CAST({c} AS DOUBLE) * {f}" for c, f in zip(rest, FEATURES, strict=True)) + "))), 9)"


def _fold_sql(train_start: str = "0") -> str:
    return f"""
  SELECT CAST(i + 1 AS INTEGER) AS fold, a.trading_date AS train_start, b.trading_date AS train_end, c.trading_date AS test_start, d.trading_date AS test_end
  FROM (SELECT i, cut, {train_start} AS i0, cut + {EMBARGO} + 1 AS i2, CASE WHEN i = {N_FOLDS - 1} THEN n - 1 ELSE cut + block END AS i3
        FROM (SELECT i, n, (n - CAST(floor(n * {INITIAL}) AS BIGINT)) // {N_FOLDS} AS block, CAST(floor(n * {INITIAL}) AS BIGINT) + i * ((n - CAST(floor(n * {INITIAL}) AS BIGINT)) // {N_FOLDS}) AS cut
              FROM (SELECT count(*) AS n FROM cal), range({N_FOLDS}) r(i)))
  JOIN cal a ON a.idx = i0 JOIN cal b ON b.idx = cut JOIN cal c ON c.idx = i2 JOIN cal d ON d.idx = i3"""


def _curve(costs: str) -> str:
    return f"""
  SELECT *, cum + 0 AS cum_return, (cum + 1) / greatest(max(cum + 1) OVER w, 1.0) - 1 AS drawdown,
    CASE WHEN count(*) OVER r = 60 THEN avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) OVER r END AS hit_rate_rolling,
    CASE WHEN count(*) OVER r = 60 THEN sqrt({TRADING_DAYS}) * avg(net_return) OVER r / nullif(stddev_samp(net_return) OVER r, 0) END AS sharpe_rolling
  FROM (SELECT *, product(1 + net_return) OVER (PARTITION BY fold, strategy, cost_bps ORDER BY trading_date) - 1 AS cum
        FROM (SELECT d.*, cost_bps, gross_return - turnover * cost_bps / 10000 AS net_return FROM daily d, (SELECT unnest({costs}) AS cost_bps)))
  WINDOW w AS (PARTITION BY fold, strategy, cost_bps ORDER BY trading_date), r AS (PARTITION BY fold, strategy, cost_bps ORDER BY trading_date ROWS 59 PRECEDING)"""


def _summary(curve: str) -> str:
    return f"""
  SELECT fold, strategy, cost_bps, count(*) AS n_days, CAST(sum(n_trades) AS BIGINT) AS n_trades, arg_max(cum_return, trading_date) AS total_return,
    sqrt({TRADING_DAYS}) * avg(net_return) / nullif(stddev_samp(net_return), 0) AS sharpe, min(drawdown) AS max_drawdown,
    avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (n_active > 0) AS hit_rate,
    avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (n_active > 0) * avg(net_return) FILTER (n_active > 0 AND net_return > 0)
      - (1 - avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (n_active > 0)) * abs(avg(net_return) FILTER (n_active > 0 AND net_return < 0)) AS expectancy
  FROM {curve} GROUP BY ALL"""


def _versus(summary: str) -> str:
    return f"""
  SELECT m.*, m.sharpe - b.sharpe AS d_sharpe, m.total_return - b.total_return AS d_total FROM
  (SELECT strategy, cost_bps, avg(sharpe) AS sharpe, avg(total_return) AS total_return, avg(max_drawdown) AS max_drawdown, avg(hit_rate) AS hit_rate, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM {summary} GROUP BY ALL) m
  LEFT JOIN (SELECT cost_bps, avg(sharpe) AS sharpe, avg(total_return) AS total_return FROM {summary} WHERE strategy = 'always_long' GROUP BY ALL) b USING (cost_bps)"""


def _auc(by: str, y: str, p: str, target: str) -> str:
    """Rank sums: ties take their mean rank."""
    return f"""SELECT {by}, '{target}' AS target, (sum(CASE WHEN {y} THEN rk END) - n_pos * (n_pos + 1) / 2.0) / nullif(CAST(n_pos AS DOUBLE) * n_neg, 0) AS auc, n_pos, n_neg FROM (
    SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {p}) + (count(*) OVER (PARTITION BY {by}, {p}) - 1) / 2.0 AS rk,
      CAST(count(*) FILTER ({y}) OVER (PARTITION BY {by}) AS BIGINT) AS n_pos, CAST(count(*) FILTER (NOT {y}) OVER (PARTITION BY {by}) AS BIGINT) AS n_neg FROM preds)
    GROUP BY {by}, n_pos, n_neg"""


def _aucs(by: str) -> str:
    return _auc(by, "y_up_next_day", "p_up", "up") + " UNION ALL " + _auc(by, "y_large_move_next", "p_large_move", "large_move")


_EVENT_COLUMNS = """o_orderkey AS event_id, o_orderpriority AS event_type, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS event_ts,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 1 END AS event_date, o_totalprice AS actual,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 0.0 ELSE o_totalprice * (1 + ((o_orderkey % 7) - 3) / CAST(100.0 AS DOUBLE)) END AS forecast, 'Order ' || o_orderkey AS cleaned_text"""

CTE = {
    "assets": """SELECT row_number() OVER (ORDER BY s_name) AS asset_id, s_name AS symbol, s_name AS name, CASE WHEN s_suppkey % 2 <> 0 THEN 'equity' ELSE 'etf' END AS asset_type,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'EUR' ELSE 'USD' END AS currency, n_name AS exchange, 'supplier' AS source FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "prices": """SELECT s_name AS symbol, d AS trading_date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, arg_max(p * (1 - l_discount / 10), k) AS adj_close, sum(l_quantity) AS volume, 'lineitem' AS source
    FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, 1000 + l_extendedprice / 1000 AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, d""",
    "bars": "SELECT asset_id, p.* EXCLUDE (symbol) FROM prices p JOIN assets USING (symbol)",
    "feat": """SELECT *, stddev_samp(logret_1d) OVER (PARTITION BY asset_id ORDER BY trading_date ROWS 19 PRECEDING) AS vol_20d FROM (
    SELECT asset_id, trading_date, adj_close, adj_close / nullif(lag(adj_close) OVER w, 0) - 1 AS ret_1d, CASE WHEN lag(adj_close) OVER w > 0 AND adj_close > 0 THEN ln(adj_close / lag(adj_close) OVER w) END AS logret_1d,
      adj_close / nullif(lag(adj_close, 5) OVER w, 0) - 1 AS mom_5d, adj_close / nullif(lag(adj_close, 20) OVER w, 0) - 1 AS mom_20d,
      adj_close / nullif(max(adj_close) OVER (PARTITION BY asset_id ORDER BY trading_date ROWS 59 PRECEDING), 0) - 1 AS drawdown_60d
    FROM bars WINDOW w AS (PARTITION BY asset_id ORDER BY trading_date))""",
    "lab": """SELECT *, abs(ret_fwd_1d) AS abs_ret_fwd_1d, ret_fwd_1d > 0 AS y_up_next_day, abs(ret_fwd_1d) > 2.0 * vol_20d AS y_large_move_next FROM (
    SELECT *, lead(adj_close) OVER (PARTITION BY asset_id ORDER BY trading_date) / nullif(adj_close, 0) - 1 AS ret_fwd_1d FROM feat)""",
    "ds": f"SELECT asset_id, symbol, trading_date, {_F}, {_L} FROM lab JOIN assets USING (asset_id) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in (*FEATURES, *LABELS)),
    "cal": "SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS idx FROM (SELECT DISTINCT trading_date FROM ds)",
    "folds": _fold_sql(),
    "rolling": _fold_sql("greatest(0, cut - 499)"),
    "sp": "SELECT fold, ds.*, CASE WHEN trading_date BETWEEN train_start AND train_end THEN 'train' ELSE 'test' END AS role FROM ds JOIN folds ON trading_date BETWEEN train_start AND train_end OR trading_date BETWEEN test_start AND test_end",
    "spp": f"SELECT *, {_linear('p_up')} AS p_up, {_linear('p_large_move')} AS p_large_move FROM sp",
    "preds": "SELECT *, CASE WHEN p_up > 0.55 THEN 1 WHEN p_up < 0.45 THEN -1 ELSE 0 END AS signal FROM spp WHERE role = 'test'",
    "pos": """SELECT fold, asset_id, trading_date, strategy, ret_fwd_1d, CAST(CASE strategy WHEN 'direction_threshold' THEN signal WHEN 'always_long' THEN 1 ELSE CASE WHEN p_large_move > 0.10 THEN 0 ELSE 1 END END AS DOUBLE) AS position
    FROM preds, (SELECT unnest(['direction_threshold', 'large_move_filter', 'always_long']) AS strategy)""",
    "turn": "SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY fold, strategy, asset_id ORDER BY trading_date), 0)) AS turnover FROM pos",
    "daily": """SELECT fold, strategy, trading_date, avg(position) AS avg_position, avg(turnover) AS turnover, avg(position * ret_fwd_1d) AS gross_return,
    CAST(count(*) FILTER (position <> 0) AS BIGINT) AS n_active, CAST(count(*) FILTER (turnover > 0) AS BIGINT) AS n_trades FROM turn GROUP BY ALL""",
    "curve": _curve("[CAST(1.5 AS DOUBLE)]"),
    "curves": _curve("[CAST(0.0 AS DOUBLE), 1.5, 5.0]"),
    "summary": _summary("curve"),
    "summaries": _summary("curves"),
    "copied": "SELECT * FROM prices UNION ALL SELECT * REPLACE ('COPY ' || symbol AS symbol) FROM prices WHERE right(symbol, 2) IN ('00', '50')",
    "series": "SELECT symbol, count(*) AS n, md5(string_agg(coalesce(CAST(close AS VARCHAR), '') || '|' || coalesce(CAST(volume AS VARCHAR), ''), ',' ORDER BY trading_date)) AS fp FROM copied GROUP BY symbol",
    "ev": f"SELECT *, lag(actual) OVER (PARTITION BY event_type ORDER BY event_ts, event_id) AS previous, actual - forecast AS surprise FROM (SELECT {_EVENT_COLUMNS} FROM orders)",
    "pcal": "SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS idx FROM (SELECT DISTINCT trading_date FROM prices)",
    # Eastern time by the rule in force through the tables' years: from the first Sunday of April to the last of October.
    "loc": """SELECT *, event_ts - CASE WHEN event_ts >= make_date(year(event_ts), 4, 1) + CAST((7 - dayofweek(make_date(year(event_ts), 4, 1))) % 7 AS INTEGER) + to_hours(7)
      AND event_ts < make_date(year(event_ts), 10, 31) - CAST(dayofweek(make_date(year(event_ts), 10, 31)) AS INTEGER) + to_hours(6) THEN to_hours(4) ELSE to_hours(5) END AS local_ts FROM ev""",
    "sess": """SELECT l.*, (SELECT min(trading_date) FROM pcal WHERE trading_date >= coalesce(l.event_date, CAST(l.local_ts AS DATE) + CASE WHEN strftime(l.local_ts, '%H:%M') >= '16:00' THEN 1 ELSE 0 END)) AS session FROM loc l""",
    "newest": "SELECT event_type, session, arg_max(row(surprise), row(event_ts, event_id)) AS s FROM sess WHERE session IS NOT NULL GROUP BY ALL",
    "grid": "SELECT c.*, t.event_type FROM pcal c CROSS JOIN (SELECT DISTINCT event_type FROM ev) t",
    "dist": """SELECT trading_date, event_type, CAST(least(idx - max(seen) OVER (PARTITION BY event_type ORDER BY idx), 30) AS INTEGER) AS days_since, CAST(least(min(seen) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx, 30) AS INTEGER) AS days_until, seen IS NOT NULL AS is_event_day
    FROM (SELECT g.*, CASE WHEN s.session IS NOT NULL THEN idx END AS seen FROM grid g LEFT JOIN newest s ON s.session = g.trading_date AND s.event_type = g.event_type)""",
    "car": """SELECT asset_id, trading_date, CASE WHEN n_est = 55 AND n_win = 11 THEN sum_ret - n_win * alpha - beta * sum_mkt END AS car FROM (
      SELECT *, count(*) OVER b AS n_est, regr_slope(ret_1d, mkt) OVER b AS beta, regr_intercept(ret_1d, mkt) OVER b AS alpha, count(*) OVER a AS n_win, sum(ret_1d) OVER a AS sum_ret, sum(mkt) OVER a AS sum_mkt
      FROM (SELECT asset_id, trading_date, ret_1d, avg(ret_1d) OVER (PARTITION BY trading_date) AS mkt FROM feat WHERE ret_1d IS NOT NULL)
      WINDOW b AS (PARTITION BY asset_id ORDER BY trading_date ROWS BETWEEN 60 PRECEDING AND 6 PRECEDING), a AS (PARTITION BY asset_id ORDER BY trading_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))""",
    "wide": "SELECT symbol, name FROM assets UNION ALL SELECT c_name, c_name FROM customer",
    "aucs": _aucs("fold"),
    "aucs_symbol": _aucs("fold, symbol"),
}


def _needs(sql: str, seen: set[str]) -> None:
    for name in CTE:
        if name not in seen and re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b", sql):
            _needs(CTE[name], seen)
            seen.add(name)


def _with(sql: str) -> str:
    seen: set[str] = set()
    _needs(sql, seen)
    order = [n for n in CTE if n in seen]
    head = "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) if order else ""
    return f"{head}\n{sql}"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 8) AS {c}" for c in columns)


def _assert(check: str, detail: str, source: str, bad: str = "true", worst: str | None = None) -> str:
    size = "CAST(NULL AS DOUBLE)" if worst is None else f"round(coalesce(max({worst}), 0.0), 8)"
    return f"SELECT '{check}' AS check, CAST(count(*) FILTER ({bad}) AS BIGINT) AS n_violations, {size} AS worst, '{detail}' AS detail FROM {source}"


_PRICE = "open, high, low, close, adj_close, volume".split(", ")
_PER = ("sharpe", "total_return", "max_drawdown", "hit_rate")
_VERSUS = f"SELECT strategy, cost_bps, n_trades, {_r(*_PER, 'd_sharpe', 'd_total')} FROM "

_QUERIES = {
    "asset_dim": "SELECT * FROM assets",
    "bars": f"SELECT asset_id, trading_date, source, {_r(*_PRICE)} FROM bars",
    "features_daily": f"SELECT asset_id, trading_date, {_r(*FEATURES)} FROM feat",
    "labels_daily": f"SELECT asset_id, trading_date, {_r(*LABELS[:2])}, y_up_next_day, y_large_move_next FROM lab",
    "training_dataset": f"SELECT asset_id, symbol, trading_date, {_r(*FEATURES, *LABELS[:2])}, y_up_next_day, y_large_move_next FROM ds",
    "settled_bars": "SELECT asset_id, count(*) AS n, max(trading_date) AS last_date FROM bars WHERE trading_date < DATE '2000-06-14' GROUP BY asset_id",
    "validate_summary": """SELECT unnest(['blank_symbols', 'missing_keys', 'negative_values', 'inverted_range', 'future_dates', 'blank_event_types', 'undated_events', 'duplicate_symbols', 'duplicate_prices', 'duplicate_series', 'assets_without_prices', 'orphan_prices']) AS check,
      unnest([(SELECT count(*) FROM wide WHERE trim(symbol) = ''), (SELECT count(*) FROM copied WHERE trim(symbol) = '' OR trading_date IS NULL), (SELECT count(*) FROM copied WHERE least(open, high, low, close, adj_close, volume) < 0),
      (SELECT count(*) FROM copied WHERE high < low), (SELECT count(*) FROM copied WHERE trading_date > DATE '2000-06-18'), (SELECT count(*) FROM ev WHERE trim(event_type) = ''), (SELECT count(*) FROM ev WHERE event_ts IS NULL AND event_date IS NULL),
      (SELECT count(*) FROM (SELECT symbol FROM wide GROUP BY symbol HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT symbol, trading_date FROM copied GROUP BY ALL HAVING count(*) > 1)),
      (SELECT count(*) FROM (SELECT n, fp FROM series GROUP BY n, fp HAVING count(*) > 1)),
      (SELECT count(*) FROM wide WHERE symbol NOT IN (SELECT symbol FROM copied)), (SELECT count(*) FROM copied WHERE symbol NOT IN (SELECT symbol FROM wide))]) AS n_violations""",
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "duplicate_series": "SELECT n, string_agg(symbol, ', ' ORDER BY symbol) AS symbols FROM series GROUP BY n, fp HAVING count(*) > 1",
    "assets_without_prices": "SELECT symbol, name FROM wide WHERE symbol NOT IN (SELECT symbol FROM prices)",
    "inverted_and_future": "SELECT symbol, trading_date, round(close, 8) AS close FROM prices WHERE trading_date > DATE '2000-06-18' UNION ALL SELECT symbol, trading_date, round(close, 8) AS close FROM prices WHERE high < low",
    "orphan_offenders": "SELECT string_agg(symbol, ', ' ORDER BY symbol) AS offenders FROM (SELECT DISTINCT symbol FROM copied WHERE symbol NOT IN (SELECT symbol FROM assets))",
    "embargo_reach": """SELECT fold, count(*) AS n_test, CAST(count(*) FILTER (reach <= train_end) AS BIGINT) AS n_reaching
      FROM (SELECT asset_id, trading_date, lag(trading_date, 59) OVER (PARTITION BY asset_id ORDER BY trading_date) AS reach FROM ds) JOIN folds ON trading_date BETWEEN test_start AND test_end GROUP BY fold""",
    "folds": "SELECT * FROM folds",
    "rolling_folds": "SELECT * FROM rolling",
    "fold_split_counts": "SELECT fold, role, count(*) AS n_rows, min(trading_date) AS first_date, max(trading_date) AS last_date FROM sp GROUP BY ALL",
    "fold_scalers": " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, round(avg({f}), 8) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END, 8) AS std FROM sp WHERE role = 'train' GROUP BY fold" for f in FEATURES),
    "predictions_fixed": "SELECT fold, asset_id, trading_date, p_up, p_large_move, CAST(signal AS INTEGER) AS signal FROM preds",
    "positions": "SELECT fold, asset_id, trading_date, strategy, position, turnover FROM turn",
    "daily_portfolio": f"SELECT fold, strategy, trading_date, cost_bps, n_active, n_trades, {_r('avg_position', 'turnover', 'gross_return', 'net_return', 'cum_return', 'drawdown', 'hit_rate_rolling', 'sharpe_rolling')} FROM curve",
    "backtest_summary": f"SELECT fold, strategy, cost_bps, n_days, n_trades, {_r(*_PER, 'expectancy')} FROM summary",
    "strategy_vs_benchmark": f"{_VERSUS} ({_versus('summary')})",
    "cost_sensitivity": f"{_VERSUS} ({_versus('summaries')})",
    "latest_backtests": "SELECT CAST(fold AS BIGINT) AS model_run_id, strategy, CAST(1000 + fold * 10 + CASE strategy WHEN 'always_long' THEN 1 WHEN 'direction_threshold' THEN 2 ELSE 3 END AS BIGINT) AS backtest_run_id FROM summary",
    "confusion": """SELECT *, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 8) AS precision FROM (SELECT fold, count(*) FILTER (p_up > 0.55 AND y_up_next_day) AS tp, count(*) FILTER (p_up > 0.55 AND NOT y_up_next_day) AS fp,
      count(*) FILTER (p_up <= 0.55 AND y_up_next_day) AS fn, count(*) FILTER (p_up <= 0.55 AND NOT y_up_next_day) AS tn FROM preds GROUP BY fold)""",
    "calibration_fixed": """SELECT fold, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p_up), 8) AS predicted, round(avg(CAST(y_up_next_day AS INTEGER)), 8) AS realized
      FROM (SELECT *, len(list_filter(list_transform(range(21), lambda k: k * CAST(0.05 AS DOUBLE)), lambda e: e <= p_up)) - 1 AS bin FROM preds) WHERE bin BETWEEN 0 AND 19 GROUP BY fold, bin""",
    "calibration_decile": """SELECT CAST(greatest(len(list_filter(edges, lambda e: e < p_large_move)) - 1, 0) AS INTEGER) AS bin, count(*) AS n, round(avg(p_large_move), 8) AS predicted, round(avg(CAST(y_large_move_next AS INTEGER)), 8) AS realized
      FROM preds, (SELECT list_sort(list_distinct(quantile_cont(p_large_move, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM preds) GROUP BY ALL""",
    "naive_baseline": """SELECT fold, majority, round(avg(CAST(y_up_next_day = (majority = 1) AS INTEGER)), 8) AS naive_accuracy, round(avg(CAST(y_up_next_day = (p_up > 0.55) AS INTEGER)), 8) AS model_accuracy, round(avg(CAST(y_up_next_day AS INTEGER)), 8) AS base_rate
      FROM preds JOIN (SELECT fold, CAST(round_even(avg(CAST(y_up_next_day AS INTEGER)), 0) AS INTEGER) AS majority FROM sp WHERE role = 'train' GROUP BY fold) USING (fold) GROUP BY fold, majority""",
    "auc_by_fold": "SELECT fold, target, round(auc, 8) AS auc, n_pos, n_neg FROM aucs",
    "auc_by_symbol": "SELECT fold, symbol, target, round(auc, 8) AS auc, n_pos, n_neg FROM aucs_symbol",
    "auc_summary": "SELECT target, round(avg(auc), 8) AS mean, round(stddev_pop(auc), 8) AS std, round(min(auc), 8) AS min, round(max(auc), 8) AS max, count(auc) AS n FROM aucs GROUP BY target",
    "auc_symbol_summary": """SELECT symbol, round(avg(auc) FILTER (target = 'up'), 8) AS up_mean, round(stddev_pop(auc) FILTER (target = 'up'), 8) AS up_std, round(avg(auc) FILTER (target = 'large_move'), 8) AS large_mean, round(stddev_pop(auc) FILTER (target = 'large_move'), 8) AS large_std,
      CAST(greatest(count(*) FILTER (target = 'up'), count(*) FILTER (target = 'large_move')) AS BIGINT) AS folds FROM aucs_symbol WHERE auc IS NOT NULL GROUP BY symbol""",
    "paired_deltas": f"SELECT fold, round(a.auc, 8) AS a, round(b.auc, 8) AS b, round(b.auc - a.auc, 8) AS delta FROM ({_auc('fold', 'y_up_next_day', 'p_up', 'a')}) a JOIN ({_auc('fold', 'y_up_next_day', 'p_large_move', 'b')}) b USING (fold)",
    "brier": "SELECT fold, round(avg(pow(p_large_move - CAST(y_large_move_next AS INTEGER), 2)), 8) AS brier FROM preds GROUP BY fold",
    "proportional_sizing": """SELECT fold, CAST(len(list_filter(list_transform(range(21), lambda k: k * CAST(0.05 AS DOUBLE)), lambda e: e <= p_up)) - 1 AS INTEGER) AS bin, count(*) AS n, round(avg((p_up - 0.5) * 2.0), 8) AS avg_position, round(avg(100 * (1 + sign(p_up - 0.5) * CAST(0.0005 AS DOUBLE))), 8) AS avg_fill FROM preds GROUP BY ALL""",
    "assert_forward": _assert("forward_return", "ret_fwd_1d(t) = ret_1d(t+1)", "(SELECT abs(ret_fwd_1d - lead(ret_1d) OVER (PARTITION BY asset_id ORDER BY trading_date)) AS gap FROM lab)", "gap > 1e-9", "gap"),
    "assert_labels": _assert("label_definitions", "labels follow from the return and vol_20d", "lab", "y_up_next_day IS DISTINCT FROM (ret_fwd_1d > 0)"),
    "assert_signs": _assert("signs", "vol_20d >= 0, drawdown_60d <= 0", "feat", "vol_20d < 0 OR drawdown_60d > 1e-9", "greatest(-vol_20d, drawdown_60d, 0.0)"),
    "assert_no_nulls": _assert("no_nulls", "no null in the training dataset", "ds", "ret_1d IS NULL", "CASE WHEN ret_1d IS NULL THEN 1.0 ELSE 0.0 END"),
    "assert_row_counts": _assert("row_counts", "rows of an asset = bars - 21", "(SELECT * FROM (SELECT asset_id, greatest(count(*) - 21, 0) AS w FROM bars GROUP BY 1) LEFT JOIN (SELECT asset_id, count(*) AS h FROM ds GROUP BY 1) USING (asset_id) WHERE w <> coalesce(h, 0))", "true", "CAST(abs(coalesce(h, 0) - w) AS DOUBLE)"),
    "assert_out_of_sample": _assert("out_of_sample", "predictions lie in the test window", "preds JOIN folds USING (fold)", "trading_date < test_start OR trading_date > test_end OR trading_date <= train_end"),
    "assert_net_identity": _assert("net_identity", "net = gross - turnover * cost", "curve", "abs(net_return - (gross_return - turnover * cost_bps / 10000)) > 1e-9", "abs(net_return - (gross_return - turnover * cost_bps / 10000))"),
    "assert_events": _assert("events", "sessions exist and follow the release", "sess", "session < CAST(event_ts AS DATE)"),
    "events_staged": "SELECT event_id, event_type, coalesce(event_date, CAST(event_ts AS DATE)) AS event_date, cleaned_text, round(previous, 8) AS previous, round(surprise, 8) AS surprise, round(surprise / nullif(abs(forecast), 0), 8) AS surprise_pct FROM ev",
    "event_asset_map": "SELECT event_id, asset_id, CAST(1.0 AS DOUBLE) AS weight FROM ev CROSS JOIN assets",
    "event_map_weighted": """SELECT event_id, asset_id, round(w / sum(w) OVER (PARTITION BY event_id), 8) AS weight FROM (SELECT event_id, asset_id, sum(l_extendedprice) AS w
      FROM ev JOIN lineitem ON l_orderkey = event_id JOIN supplier ON l_suppkey = s_suppkey JOIN assets ON symbol = s_name GROUP BY ALL)""",
    "event_effective_session": "SELECT event_id, event_type, session FROM sess",
    "last_surprise_asof": "SELECT g.trading_date, g.event_type, n.session AS event_date, round(n.s[1], 8) AS surprise FROM grid g ASOF LEFT JOIN newest n ON n.event_type = g.event_type AND n.session <= g.trading_date",
    "surprise_std": "SELECT event_id, round(surprise / nullif(stddev_samp(surprise) OVER (PARTITION BY event_type ORDER BY event_ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0), 8) AS surprise_std FROM ev",
    "event_day_distance": "SELECT * FROM dist",
    "event_features": "SELECT ds.trading_date, event_type, asset_id, round(mom_20d, 8) AS mom_20d, days_since, days_until, is_event_day, round(CASE WHEN is_event_day THEN mom_20d ELSE 0.0 END, 8) AS mom_20d_event FROM ds LEFT JOIN dist ON dist.trading_date = ds.trading_date",
    "event_car": "SELECT asset_id, trading_date, event_type, round(car, 8) AS car FROM car JOIN newest ON session = trading_date",
    "event_day_slice": """SELECT event_type, is_event_day, count(*) AS n, round(avg(p_large_move), 8) AS predicted, round(avg(CAST(y_large_move_next AS INTEGER)), 8) AS realized, round(avg(pow(p_large_move - CAST(y_large_move_next AS INTEGER), 2)), 8) AS brier
      FROM preds JOIN dist ON dist.trading_date = preds.trading_date GROUP BY ALL""",
    "stream_bars": """SELECT asset_id, trading_date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, n_ticks FROM (SELECT user_id AS asset_id, CAST(ts AS DATE) AS trading_date, arg_min(100 + value / 100, row(ts, event_id)) AS open, max(100 + value / 100) AS high, min(100 + value / 100) AS low, arg_max(100 + value / 100, row(ts, event_id)) AS close, count(*) AS n_ticks FROM events GROUP BY ALL)
      WHERE trading_date < (SELECT max(CAST(ts AS DATE)) FROM events)""",
}
# Joins of predictions, runs and daily results.
_SCORED = """SELECT fold, a.symbol, p.trading_date, round(p_up, 8) AS p_up, round(p_large_move, 8) AS p_large_move, round(l.ret_fwd_1d, 8) AS ret_fwd_1d, l.y_up_next_day, l.y_large_move_next
      FROM preds p JOIN lab l ON l.asset_id = p.asset_id AND l.trading_date = p.trading_date JOIN assets a ON a.asset_id = p.asset_id WHERE l.ret_fwd_1d IS NOT NULL"""
_QUERIES |= {
    "scored_predictions": _SCORED,
    "evaluation_rows": f"{_SCORED} AND l.y_up_next_day IS NOT NULL AND l.y_large_move_next IS NOT NULL",
    "backtest_series": """SELECT CAST(1000 + fold * 10 + CASE strategy WHEN 'always_long' THEN 1 WHEN 'direction_threshold' THEN 2 ELSE 3 END AS BIGINT) AS backtest_run_id, CAST(fold AS BIGINT) AS model_run_id, strategy, trading_date, round(net_return, 8) AS net_return, round(cum_return, 8) AS cum_return FROM curve""",
    "model_runs": "SELECT CAST(fold AS BIGINT) AS model_run_id, 'logreg' AS model_name, 'v1' AS feature_set_version, train_start, train_end, test_start, test_end, CAST(NULL AS VARCHAR) AS git_commit FROM folds",
}
# Declared keys, references and conditions, over the tables in SQL.
_BACKTEST_IDS = "CAST(fold AS BIGINT) AS model_run_id, unnest([0, 1000]) + fold * 10 + CASE strategy WHEN 'always_long' THEN 1 WHEN 'direction_threshold' THEN 2 ELSE 3 END AS backtest_run_id"
_TABLES = {
    "raw_assets": "assets", "raw_prices": "copied", "assets": "assets", "prices": "bars", "events": "ev", "features": "feat", "labels": "lab",
    "event_asset_map": "(SELECT event_id, asset_id FROM ev JOIN lineitem ON l_orderkey = event_id JOIN supplier ON l_suppkey = s_suppkey JOIN assets ON symbol = s_name GROUP BY ALL)",
    "model_runs": "(SELECT fold AS model_run_id FROM folds)", "predictions": "(SELECT *, fold AS model_run_id FROM preds)",
    "backtest_runs": f"(SELECT *, {_BACKTEST_IDS} FROM summary)", "backtest_results": f"(SELECT *, {_BACKTEST_IDS} FROM curve)",
}


def _rules() -> str:
    found = []
    for name, (keys, parents, checks) in DECLARED.items():
        one = f"SELECT '{name}' AS table, '%s' AS rule, count(*) AS n_violations FROM %s"
        found.append(one % ("key", f"(SELECT 1 FROM {_TABLES[name]} GROUP BY {', '.join(keys)} HAVING count(*) > 1)"))
        found += [one % (f"{c} of {parent}", f"{_TABLES[name]} WHERE {c} NOT IN (SELECT {c} FROM {_TABLES[parent]})") for c, parent in parents.items()]
        found += [one % (rule, f"{_TABLES[name]} WHERE NOT ({condition})") for rule, condition in checks.items()]
    return " UNION ALL ".join(found)


_QUERIES["declared_violations"] = _rules()
# Tables that were written and read again.
_QUERIES |= {
    "stored_assets": "SELECT s_name AS symbol, s_name AS name, CASE WHEN s_suppkey % 2 <> 0 THEN 'equity' END AS asset_type, CASE WHEN s_suppkey % 3 <> 0 THEN 'EUR' END AS currency, n_name AS exchange, 'supplier' AS source FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "stored_prices": f"SELECT symbol, trading_date, source, {_r(*_PRICE)} FROM prices",
    "stored_events": """SELECT event_type, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_date, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS source, round(actual, 8) AS actual, round(forecast, 8) AS forecast, round(previous, 8) AS previous, '  ' || cleaned_text || ' ' AS raw_text FROM ev""",
    "vendor_prices": """SELECT 'LINES' AS symbol, 'vendor' AS source, CAST(l_shipdate AS DATE) AS trading_date, count(*) AS n, count(*) FILTER (l_discount <> 0) AS n_adjusted, round(max(l_extendedprice), 8) AS high, round(sum(l_quantity), 8) AS volume FROM lineitem GROUP BY ALL""",
    "stored_layer": _QUERIES["features_daily"],
    "stored_runs": f"SELECT CAST(fold + (SELECT max(fold) FROM folds) AS INTEGER) AS model_run_id, strategy, cost_bps, n_days, n_trades, {_r(*_PER, 'expectancy')} FROM summary",
    "stream_bars_live": _QUERIES["stream_bars"],
    "stream_days": "SELECT DISTINCT user_id AS asset_id, CAST(ts AS DATE) AS trading_date FROM events",
}
# The market's clock: five hours behind, four from the second Sunday of March, 7:00, to the first of November, 6:00 (fixed values of New York since 2007).
_SUNDAY = "(CAST(make_date(CAST(year(ts) AS INTEGER), {month}, 1) + CAST((7 - isodow(make_date(CAST(year(ts) AS INTEGER), {month}, 1))) % 7 + {days} AS INTEGER) AS TIMESTAMP) + INTERVAL {hour} HOUR)"
_YEAR = "(SELECT user_id, value, event_id, TIMESTAMP '2024-01-01' + (ts - TIMESTAMP '2024-01-01') * 12 AS ts FROM events)"
_LOCAL = f"ts - CASE WHEN ts >= {_SUNDAY.format(month=3, days=7, hour=7)} AND ts < {_SUNDAY.format(month=11, days=0, hour=6)} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END"
_QUERIES |= {
    # Every day but those that end less than an hour before the last tick, or after it.
    "market_bars_live": f"""SELECT asset_id, trading_date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, n_ticks FROM (
      SELECT user_id AS asset_id, CAST({_LOCAL} AS DATE) AS trading_date, arg_min(100 + value / 100, row(ts, event_id)) AS open, max(100 + value / 100) AS high, min(100 + value / 100) AS low, arg_max(100 + value / 100, row(ts, event_id)) AS close, count(*) AS n_ticks FROM {_YEAR} GROUP BY ALL)
      WHERE trading_date < (SELECT max(CAST({_LOCAL} - INTERVAL 1 HOUR AS DATE)) FROM {_YEAR})""",
    "surprise_std_all": "SELECT event_id, round(surprise / nullif(stddev_samp(surprise) OVER (PARTITION BY event_type ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 8) AS surprise_std FROM ev",
    "run_appends": """SELECT CAST(fold + after AS BIGINT) AS model_run_id, 'logreg' AS model_name, 'v1' AS feature_set_version, train_start, train_end, test_start, test_end, CAST(NULL AS VARCHAR) AS git_commit, n_predictions, first_date, last_date, mean_p_up
      FROM folds JOIN (SELECT fold, count(*) AS n_predictions, min(trading_date) AS first_date, max(trading_date) AS last_date, round(avg(p_up), 8) AS mean_p_up FROM preds GROUP BY fold) USING (fold),
        (SELECT unnest([0, (SELECT count(*) FROM folds)]) AS after)""",
    "prices_of_whole_files": f"SELECT symbol, trading_date, source, {_r(*_PRICE)} FROM prices WHERE right(symbol, 1) NOT IN ('3', '7')",
    "rejected_files": "SELECT symbol, count(*) + CASE WHEN right(symbol, 1) = '3' THEN 1 ELSE 0 END AS n_rows, CASE WHEN right(symbol, 1) = '3' THEN 1 ELSE 0 END AS n_bad, right(symbol, 1) = '3' AS has_header FROM prices WHERE right(symbol, 1) IN ('3', '7') GROUP BY symbol",
}
_COPIES = "FROM (SELECT DISTINCT symbol FROM copied WHERE symbol NOT IN (SELECT symbol FROM assets))"
_QUERIES |= {
    "orphan_message": f"""SELECT 'orphan prices' AS check, count(*) AS n_offenders, 'orphan prices: ' || CASE WHEN count(*) = 0 THEN 'none' ELSE min(symbol) || CASE WHEN count(*) > 1 THEN ' and ' || (count(*) - 1) || ' more' ELSE '' END END AS message {_COPIES}""",
    "auc_report": f"""SELECT 'pooled' AS level, target, 0 AS fold, 'all' AS symbol, round(auc, 8) AS auc, n_pos, n_neg FROM (SELECT * EXCLUDE (one) FROM ({_aucs("one").replace("FROM preds", "FROM (SELECT *, 1 AS one FROM preds)")}))
      UNION ALL SELECT 'fold', target, fold, 'all', round(auc, 8), n_pos, n_neg FROM aucs UNION ALL SELECT 'symbol', target, fold, symbol, round(auc, 8), n_pos, n_neg FROM aucs_symbol""",
}
_QUERIES["training_dataset_joined"] = _QUERIES["bucketed_dataset"] = _QUERIES["training_dataset"]

ORACLES = {name: _with(sql) for name, sql in _QUERIES.items()}
