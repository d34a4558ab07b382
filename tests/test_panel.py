"""Hand-computed cases of folds, sessions, evaluation, backtests and checks."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.functions.columns import LONG_THRESHOLD, longest_lookback
from panelforge.operators import assertions, backtest, evaluate, staging, validate
from panelforge.operators.folds import EMBARGO, fold_bounds
from panelforge.schemas import FEATURES

DAY = date(2018, 1, 1)


def days(n):
    return [DAY + timedelta(i) for i in range(n)]


def portfolio(spark, positions, returns, cost=0.0, asset=None):
    rows = [(1, (asset or [1] * len(positions))[i], days(len(positions))[i if asset is None else 0], "s", float(p), float(r)) for i, (p, r) in enumerate(zip(positions, returns, strict=True))]
    df = spark.createDataFrame(rows, "fold int, asset_id long, trading_date date, strategy string, position double, ret_fwd_1d double")
    return backtest.equity_curve(backtest.daily_portfolio(df, [cost]))


def column(df, name):
    return [r[0] for r in df.orderBy("trading_date").select(name).collect()]


def test_folds_leave_the_embargo():
    folds = fold_bounds(2146)
    assert len(folds) == 5
    assert all(test - cut == EMBARGO + 1 for _, _, cut, test, _ in folds)
    assert folds[-1][4] == 2145
    assert all(a[4] < b[3] and a[2] < b[2] for a, b in zip(folds, folds[1:], strict=False))
    assert {f[1] for f in folds} == {0}


def test_folds_raise_when_the_embargo_eats_a_block():
    with pytest.raises(ValueError, match="embargo_days"):
        fold_bounds(300)


def test_embargo_covers_every_lookback():
    assert longest_lookback(FEATURES) <= EMBARGO


def test_rolling_window_is_fixed():
    assert {cut - first for _, first, cut, _, _ in fold_bounds(2146, train_window=500)} == {499}


def test_settled_bars_use_the_market_date(spark):
    bars = spark.createDataFrame([("A", date(2026, 8, d)) for d in (24, 25, 26)], "symbol string, trading_date date")
    kept = staging.settled_bars(bars, datetime(2026, 8, 27, 1, 0))
    assert sorted(r[1].day for r in kept.collect()) == [24, 25]


def test_turnover_charges_the_entry(spark):
    assert column(portfolio(spark, [1, 1], [0, 0]), "turnover") == [1, 0]
    assert column(portfolio(spark, [1, 1, -1], [0, 0, 0], 10), "net_return") == pytest.approx([-0.001, 0, -0.002])


def test_returns_compound_and_drawdown_is_from_the_peak(spark):
    assert column(portfolio(spark, [1, 1], [0.1, 0.1]), "cum_return")[-1] == pytest.approx(0.21)
    assert column(portfolio(spark, [1, 1], [0.1, -0.1]), "drawdown") == pytest.approx([0, -0.1])


def test_summary(spark):
    one = lambda *a: backtest.summarize(portfolio(spark, *a)).first()
    assert one([1, 1, 1], [-0.2, 0.1, 0.1])["max_drawdown"] == pytest.approx(-0.2)
    assert one([1, 0, 0, 1], [0.01, 0.05, -0.05, 0.01])["hit_rate"] == 1.0
    assert one([1, 1, 1], [0.0, 0.0, 0.0])["sharpe"] is None


def test_assets_weigh_alike(spark):
    assert column(portfolio(spark, [1, 1], [0.1, 0.2], 0.0, [1, 2]), "gross_return") == pytest.approx([0.15])


def test_auc(spark):
    rows = [("AAA", y, p) for y, p in ((0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9))] + [("BBB", y, p) for y, p in ((1, 0.1), (0, 0.9))] + [("ONE", 1, 0.5)] + [("TIE", y, 0.5) for y in (0, 1, 1)]
    df = spark.createDataFrame(rows, "symbol string, y int, p double")
    assert {r["symbol"]: r["auc"] for r in evaluate.auc(df, "y", "p", ["symbol"]).collect()} == {"AAA": 1.0, "BBB": 0.0, "ONE": None, "TIE": 0.5}


def test_auc_equals_pairs_across_slices(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = evaluate.auc(spark.createDataFrame(rows, "y int, p double").withColumn("g", F.lit(1)), "y", "p", ["g"]).first()["auc"]
    assert got == pytest.approx(want, abs=1e-12)


def test_confusion_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, True, LONG_THRESHOLD), (1, True, 0.6), (1, False, 0.7)], "fold int, y_up_next_day boolean, p_up double")
    assert tuple(evaluate.confusion(df, ["fold"]).first()) == (1, 1, 1, 1, 0, 0.5)


def prices(spark, *series):
    rows = [(s, d, c, c, c, c, c, 10.0) for s, closes in series for d, c in zip(days(len(closes)), closes, strict=True)]
    return spark.createDataFrame(rows, "symbol string, trading_date date, open double, high double, low double, close double, adj_close double, volume double")


def test_copied_series_are_found(spark):
    df = prices(spark, ("A", [1.0, 2.0, 3.0]), ("B", [1.0, 2.0, 3.0]), ("C", [2.0, 1.0, 3.0]))
    assert [r["symbols"] for r in validate.duplicate_series(df).collect()] == ["A, B"]


def test_validate_names_offences(spark):
    df = prices(spark, ("A", [1.0, -2.0]))
    assets = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    none = spark.createDataFrame([], "event_type string, event_ts timestamp, event_date date")
    with pytest.raises(ValueError, match="assets_without_prices: 1; negative_values: 1"):
        validate.require_valid(validate.validate(assets, df, none, date(2020, 1, 1)))


def test_corrupted_return_is_one_violation(spark):
    from panelforge.operators.features import features_daily
    from panelforge.operators.labels import labels_daily

    bars = spark.createDataFrame([(1, d, 100.0 + (i * 7) % 5) for i, d in enumerate(days(40))], "asset_id long, trading_date date, adj_close double")
    features = features_daily(bars)
    labels = labels_daily(bars, features)
    assert assertions.assert_forward(features, labels).first()["n_violations"] == 0
    broken = labels.withColumn("ret_fwd_1d", F.when(F.col("trading_date") == days(40)[10], 0.999).otherwise(F.col("ret_fwd_1d")))
    assert assertions.assert_forward(features, broken).first()["n_violations"] == 1


def test_features_and_labels_share_one_shuffle(spark):
    from panelforge.operators.features import with_features
    from panelforge.operators.labels import with_labels

    bars = spark.createDataFrame([(1, DAY, 1.0)], "asset_id long, trading_date date, adj_close double")
    plan = with_labels(with_features(bars))._jdf.queryExecution().sparkPlan().toString() + with_labels(with_features(bars))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset_id") == 1


def test_stream_gives_settled_days_only(spark, tmp_path):
    from panelforge.streaming.bars import bars_of, run_available, stream_bars

    rows = [(1, datetime(2024, 1, d, h), float(10 * d + h), 100 * d + h) for d in (1, 2, 3) for h in (9, 15)]
    ticks = spark.createDataFrame(rows, "asset_id long, ts timestamp, price double, tick_id long")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    got = run_available(stream_bars(stream), str(tmp_path / "out"))
    want = bars_of(ticks).where(F.col("trading_date") < "2024-01-03")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_logistic_fit_is_the_penalised_optimum(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from panelforge.operators.model import fit_logistic

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.2] + 0.3)))).astype(float)
    model = fit_logistic(spark.createDataFrame([(Vectors.dense(a), bool(b)) for a, b in zip(x, y, strict=True)], ["features", "up"]), "up")
    a, w = np.column_stack((x, np.ones(400))), np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-5)
