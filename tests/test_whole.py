"""Queries over the whole tables, against their SQL."""

import math
import random
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from panelforge.operators import calibrate, evaluate, ordered, validate
from panelforge.operators.folds import generate_folds
from panelforge.operators.model import walk_forward
from panelforge.schemas import FEATURES

DATA = "/root/testdata/sf0.001"
EVENT_QUERIES = ("assert_events", "event_asset_map", "event_map_weighted", "event_effective_session", "last_surprise_asof", "event_day_distance", "event_features", "event_car", "event_day_slice")


def plain(v):
    if isinstance(v, datetime):
        return v.isoformat(" ")
    return v.isoformat() if isinstance(v, date) else v


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-8


def by_sql(name, folder=DATA):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "supplier", "customer", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in cur.description], cur.fetchall()


def agree(spark, name, folder=DATA):
    """The query's rows, which are those of its SQL."""
    columns, want = by_sql(name, folder)
    got = [tuple(map(plain, r)) for r in entry.queries()[name](spark, folder).select(*columns).collect()]
    key = lambda r: tuple((v is None, "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r if not isinstance(v, float))
    got, want = sorted(got, key=key), sorted((tuple(map(plain, r)) for r in want), key=key)
    assert len(got) == len(want)
    assert not [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))][:3]
    return [dict(zip(columns, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", EVENT_QUERIES)
def test_events_of_all_orders(spark, name):
    rows = agree(spark, name)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    if name in ("event_asset_map", "event_effective_session"):
        assert len({r["event_id"] for r in rows}) == orders.count()
    if "event_type" in rows[0]:
        assert {r["event_type"] for r in rows} == {r[0] for r in orders.select("o_orderpriority").distinct().collect()}


def test_checks_read_every_bar_and_event(spark):
    """An asset is without prices if it has none on any date."""
    customers = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert len(agree(spark, "assets_without_prices")) == customers
    counts = {r["check"]: r["n_violations"] for r in agree(spark, "validate_summary")}
    assert counts["assets_without_prices"] == customers


def test_an_asset_with_later_prices_only_has_prices(spark):
    """At sf0.01 some suppliers have no line before 1995-01-20, but all have lines later."""
    names = {r["symbol"] for r in agree(spark, "assets_without_prices", "/root/testdata/sf0.01")}
    assert not names & {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").select("s_name").collect()}


@pytest.mark.parametrize("name", ["platt", "isotonic"])
def test_every_fold_is_calibrated(spark, name):
    found = {r["fold"]: r for r in entry.queries()[name](spark, DATA).collect()}
    raw = {r["fold"]: r["brier"] for r in entry.queries()["brier"](spark, DATA).collect()}
    assert set(found) == set(raw) == {1, 2, 3, 4, 5}
    for fold, r in found.items():
        assert abs(r["brier_raw"] - raw[fold]) < 2e-6
        assert 0 < r["brier_calibrated"] < 1


@pytest.mark.parametrize("kind", ["platt", "isotonic"])
def test_a_fold_is_calibrated_on_its_own_latest_slice(spark, kind):
    """The same scores come true at other rates in each fold, and at the reverse rates before the slice."""
    fit, apply = getattr(calibrate, f"fit_{kind}"), getattr(calibrate, f"apply_{kind}")
    rates, start = {1: {0.3: 0.1, 0.7: 0.4}, 2: {0.3: 0.6, 0.7: 0.9}}, date(2000, 1, 1)
    rows = [
        (fold, "train", start + timedelta(day), p, (i < 10 * rate) == (day > 39))
        for fold, by_score in rates.items() for p, rate in by_score.items() for day in range(50) for i in range(10)
    ]
    rows += [(fold, "test", start + timedelta(60), p, True) for fold, by_score in rates.items() for p in by_score]
    df = spark.createDataFrame(rows, "fold int, role string, trading_date date, p double, y boolean")
    got = {(r["fold"], r["p"]): r["p_calibrated"] for r in calibrate.calibrate_folds(df, fit, apply, "p", "y").collect()}
    assert len(got) == 4
    for (fold, p), q in got.items():
        assert abs(q - rates[fold][p]) < 1e-4


def test_declared_rules_hold_but_for_copied_symbols(spark):
    found = {(r["table"], r["rule"]): r["n_violations"] for r in agree(spark, "declared_violations")}
    assert len(found) == 29 and found["raw_prices", "symbol of raw_assets"] > 0
    assert not [k for k, n in found.items() if n and k != ("raw_prices", "symbol of raw_assets")]


def test_declared_rules_count_what_breaks_them(spark):
    declared = {"a": (("id",), {}, {}), "b": (("id", "x"), {"id": "a"}, {"sign": "x >= 0", "small": "x < 5"})}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "id int"), spark.createDataFrame([(1, -1.0), (1, None), (3, 9.0), (3, 9.0), (None, 1.0)], "id int, x double")
    got = {(r["table"], r["rule"]): r["n_violations"] for r in validate.declared_violations({"a": a, "b": b}, declared).collect()}
    assert got == {("a", "key"): 1, ("b", "key"): 1, ("b", "id of a"): 2, ("b", "sign"): 1, ("b", "small"): 2}


@pytest.mark.parametrize("name", ["surprise_std", "events_staged", "calibration_decile", "auc_by_fold"])
def test_sliced_windows_over_the_tables(spark, monkeypatch, name):
    monkeypatch.setattr(ordered, "SLICE", 64)
    assert agree(spark, name)


def test_windows_over_the_last_rows_in_slices(spark):
    df = spark.range(500).selectExpr("cast(id % 3 as string) as kind", "timestamp_seconds(id * 40000 % 9999999) as at", "id", "id * id % 97 as x")
    add = {"s": lambda w: F.sum("x").over(w), "k": lambda w: F.count("x").over(w)}
    want = {(r["id"], r["s"], r["k"]) for r in df.withColumns({c: f(Window.partitionBy("kind").orderBy("at", "id").rowsBetween(-7, -1)) for c, f in add.items()}).collect()}
    for size in (7, 10, 1000):
        assert {(r["id"], r["s"], r["k"]) for r in ordered.over_last(df, "kind", F.to_date("at"), ("at", "id"), 7, add, size).collect()} == want


@pytest.mark.parametrize("name", ["stored_assets", "stored_prices", "stored_events", "vendor_prices", "stored_layer", "stored_runs", "stream_bars", "stream_bars_live", "stream_days"])
def test_stored_and_streamed_tables(spark, name):
    assert agree(spark, name)


def test_isotonic_map_matches_pooling(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(300)]
    at, values = calibrate.fit_isotonic(spark.createDataFrame(rows, "p double, y double"), "p", "y")
    blocks = []  # value, weight, scores: neighbours that fall are pooled
    for p in sorted({p for p, _ in rows}):
        ys = [y for q, y in rows if q == p]
        blocks.append([sum(ys) / len(ys), len(ys), [p]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, ps = blocks.pop()
            w, m, qs = blocks.pop()
            blocks.append([(v * n + w * m) / (n + m), n + m, qs + ps])
    want = {p: v for v, _, ps in blocks for p in ps}
    scores = sorted(want)
    df = spark.createDataFrame([(p,) for p in scores] + [(-1.0,), (2.0,)], "p double")
    literal = lambda xs: F.array(*map(F.lit, xs))
    got = {r[0]: r[1] for r in df.select("p", calibrate.apply_isotonic(F.col("p"), literal(at), literal(values))).collect()}
    assert all(abs(got[p] - want[p]) < 1e-9 for p in scores)
    assert (got[-1.0], got[2.0]) == (values[0], values[-1])


def test_platt_map_matches_newton(spark):
    rng = random.Random(4)
    rows = [(p := rng.uniform(0.05, 0.95), float(rng.random() < p**2)) for _ in range(400)]
    (a,), (b,) = calibrate.fit_platt(spark.createDataFrame(rows, "p double, y double"), "p", "y")
    x = np.array([[1, math.log(p / (1 - p))] for p, _ in rows])
    y, w = np.array([y for _, y in rows]), np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    assert np.allclose((a, b), w, atol=1e-5)


def test_walk_forward_scores_each_fold_by_its_own_model(spark):
    rng = np.random.default_rng(0)
    start, rows = date(2000, 1, 1), []
    for i in range(300):
        x = rng.standard_normal(6)
        rows += [(a, start + timedelta(i), *map(float, x + a), bool(x[0] + rng.standard_normal() > 0), bool(x[1] + rng.standard_normal() > 1)) for a in range(2)]
    df = spark.createDataFrame(rows, "asset_id long, trading_date date, " + ", ".join(f"{f} double" for f in FEATURES) + ", y_up_next_day boolean, y_large_move_next boolean")
    folds = generate_folds(df, n_folds=2, embargo=5)
    got = {(r["fold"], r["asset_id"], r["trading_date"]): r["p_up"] for r in walk_forward(df, folds).collect()}
    for f in folds.collect():
        train = [r for r in rows if f["train_start"] <= r[1] <= f["train_end"]]
        test = [r for r in rows if f["test_start"] <= r[1] <= f["test_end"]]
        x = np.array([r[2:8] for r in train])
        mean, spread = x.mean(axis=0), x.std(axis=0)
        x, y, w = np.column_stack((np.ones(len(x)), (x - mean) / spread)), np.array([float(r[8]) for r in train]), np.zeros(7)
        for _ in range(40):  # the penalty spares the intercept
            q = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0] + [1] * 6), x.T @ (q - y) + np.r_[0, w[1:]])
        assert len(test) == sum(k[0] == f["fold"] for k in got)
        for r in test:
            z = w[0] + (np.array(r[2:8]) - mean) / spread @ w[1:]
            assert abs(got[f["fold"], r[0], r[1]] - 1 / (1 + math.exp(-z))) < 1e-4


@pytest.mark.parametrize("name", ["scored_predictions", "evaluation_rows", "backtest_series", "model_runs"])
def test_joins_over_the_tables(spark, name):
    assert agree(spark, name)


def test_runs_are_selected(spark):
    preds = spark.range(4).withColumnRenamed("id", "model_run_id")
    assert evaluate.select_runs(preds).count() == 4
    assert {r[0] for r in evaluate.select_runs(preds, [1, 3]).collect()} == {1, 3}
