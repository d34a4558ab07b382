"""Assertions that re-derive outputs: one row each of (check, n_violations, worst, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import by_asset, differs
from panelforge.operators.labels import LARGE_MOVE

TOLERANCE = 1e-9
WARM_UP = 21


def _report(check: str, rows: DataFrame, bad: Column, size: Column | None = None, detail: str = "") -> DataFrame:
    worst = F.lit(None).cast("double") if size is None else F.coalesce(F.max(size), F.lit(0.0))
    return rows.agg(F.coalesce(F.count_if(bad), F.lit(0)).alias("n_violations"), worst.alias("worst")).select(F.lit(check).alias("check"), "n_violations", "worst", F.lit(detail).alias("detail"))


def forward_mismatch(features: DataFrame, labels: DataFrame) -> DataFrame:
    """ret_fwd_1d beside the next row's ret_1d."""
    joined = features.select("asset_id", "trading_date", "ret_1d").join(labels.select("asset_id", "trading_date", "ret_fwd_1d"), ["asset_id", "trading_date"])
    return joined.withColumn("next_ret", F.lead("ret_1d").over(by_asset()))


def assert_forward(features: DataFrame, labels: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    gap = F.abs(F.col("ret_fwd_1d") - F.col("next_ret"))
    return _report("forward_return", forward_mismatch(features, labels), gap > tol, gap, "ret_fwd_1d(t) = ret_1d(t+1)")


def assert_labels(features: DataFrame, labels: DataFrame, k: float = LARGE_MOVE) -> DataFrame:
    joined = labels.join(features.select("asset_id", "trading_date", "vol_20d"), ["asset_id", "trading_date"], "left")
    bad = differs(F.col("y_up_next_day"), F.col("ret_fwd_1d") > 0) | differs(F.col("y_large_move_next"), F.abs("ret_fwd_1d") > k * F.col("vol_20d")) | differs(F.col("abs_ret_fwd_1d"), F.abs("ret_fwd_1d"))
    return _report("label_definitions", joined, bad, detail="labels follow from the return and vol_20d")


def assert_signs(features: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    return _report("signs", features, (F.col("vol_20d") < 0) | (F.col("drawdown_60d") > tol), F.greatest(-F.col("vol_20d"), F.col("drawdown_60d"), F.lit(0.0)), "vol_20d >= 0, drawdown_60d <= 0")


def assert_no_nulls(dataset: DataFrame) -> DataFrame:
    nulls = sum(F.col(c).isNull().cast("int") for c in dataset.columns)
    return _report("no_nulls", dataset, nulls > 0, nulls.cast("double"), "no null in the training dataset")


def row_count_violations(assets: DataFrame, bars: DataFrame, dataset: DataFrame) -> DataFrame:
    """Assets whose rows in the dataset aren't all but the warm-up and the last."""
    have = dataset.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    want = bars.groupBy("asset_id").agg(F.greatest(F.count(F.lit(1)) - WARM_UP, F.lit(0)).alias("n_expected"))
    both = assets.select("asset_id", "symbol").join(want, "asset_id").join(have, "asset_id", "left")
    return both.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).where("n_rows <> n_expected")


def assert_row_counts(assets: DataFrame, bars: DataFrame, dataset: DataFrame) -> DataFrame:
    off = row_count_violations(assets, bars, dataset)
    return _report("row_counts", off, F.lit(True), F.abs(F.col("n_rows") - F.col("n_expected")).cast("double"), "rows of an asset = bars - 21")


def out_of_window(preds: DataFrame, runs: DataFrame, run: str = "fold") -> DataFrame:
    """Predictions outside their run's test window or not after its training window."""
    day = F.col("trading_date")
    joined = preds.join(F.broadcast(runs.select(run, "train_end", "test_start", "test_end")), run)
    return joined.where((day < F.col("test_start")) | (day > F.col("test_end")) | (day <= F.col("train_end")))


def assert_out_of_sample(preds: DataFrame, runs: DataFrame, run: str = "fold") -> DataFrame:
    return _report("out_of_sample", out_of_window(preds, runs, run), F.lit(True), detail="predictions lie in the test window")


def assert_net_identity(results: DataFrame, runs: DataFrame | None = None, on: Sequence[str] = ("backtest_run_id",), tol: float = TOLERANCE) -> DataFrame:
    """net = gross - turnover * cost; ``runs`` gives the cost where the results don't."""
    joined = results if runs is None else results.join(F.broadcast(runs.select(*on, "cost_bps")), list(on))
    gap = F.abs(F.col("net_return") - (F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 10000))
    return _report("net_identity", joined, gap > tol, gap, "net = gross - turnover * cost")


def assert_events(events: DataFrame, calendar: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """A session is a date of the calendar at or after release, and the surprise follows from its parts."""
    marked = events.join(F.broadcast(calendar.select(F.col("trading_date").alias("session"), F.lit(True).alias("known"))), "session", "left")
    early = F.col("session") < F.to_date("event_ts")
    bad = F.col("session").isNotNull() & (F.col("known").isNull() | early) | differs(F.round("surprise", 6), F.round(F.col("actual") - F.col("forecast"), 6))
    return _report("events", marked, F.coalesce(bad, F.lit(True)), detail="sessions exist and follow the release")
