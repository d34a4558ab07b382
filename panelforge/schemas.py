"""Declared schemas of the layers, as DDL; readers never infer one."""

from __future__ import annotations

RAW_ASSETS = "symbol string, name string, asset_type string, currency string, exchange string, source string"
RAW_PRICES = "symbol string, trading_date date, open double, high double, low double, close double, adj_close double, volume double, source string"
RAW_EVENTS = (
    "event_type string, event_ts timestamp, event_date date, title string, country string, source string, actual double, forecast double, previous double, raw_text string"
)
FEATURES = ("ret_1d", "logret_1d", "vol_20d", "mom_5d", "mom_20d", "drawdown_60d")
LABELS = ("ret_fwd_1d", "abs_ret_fwd_1d", "y_up_next_day", "y_large_move_next")

#: Of each table: its key, the tables that its columns refer to (under the same column name), and what holds for each
#: row.  Fixed values; null passes a condition.
DECLARED: dict[str, tuple[tuple[str, ...], dict[str, str], dict[str, str]]] = {
    "raw_assets": (("symbol",), {}, {}),
    "raw_prices": (("symbol", "trading_date"), {"symbol": "raw_assets"}, {}),
    "assets": (("asset_id",), {}, {}),
    "prices": (("asset_id", "trading_date"), {"asset_id": "assets"}, {"volume": "volume >= 0"}),
    "events": (("event_id",), {}, {}),
    "event_asset_map": (("event_id", "asset_id"), {"event_id": "events", "asset_id": "assets"}, {}),
    "features": (("asset_id", "trading_date"), {"asset_id": "assets"}, {}),
    "labels": (("asset_id", "trading_date"), {"asset_id": "assets"}, {}),
    "model_runs": (("model_run_id",), {}, {}),
    "predictions": (("model_run_id", "asset_id", "trading_date"), {"model_run_id": "model_runs", "asset_id": "assets"}, {"probabilities": "p_up >= 0 AND p_up <= 1 AND p_large_move >= 0 AND p_large_move <= 1"}),
    "backtest_runs": (("backtest_run_id",), {"model_run_id": "model_runs"}, {"hit_rate": "hit_rate >= 0 AND hit_rate <= 1", "drawdown": "max_drawdown <= 0", "cost": "cost_bps >= 0"}),
    "backtest_results": (("backtest_run_id", "trading_date"), {"backtest_run_id": "backtest_runs"}, {"turnover": "turnover >= 0", "drawdown": "drawdown <= 0"}),
}
