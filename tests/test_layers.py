"""Bucketed layers, models of all folds at once, isotonic maps in slices, the run sink, market days, files put aside, running moments, one-pass checks."""

import random
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from panelforge.jobs.queries import Panel, bucketed_panel
from panelforge.operators import calibrate, evaluate, events, isotonic, ordered, validate
from panelforge.operators.dataset import training_dataset
from panelforge.operators.features import features_daily
from panelforge.operators.folds import generate_folds
from panelforge.operators.labels import labels_daily
from panelforge.operators.model import TARGETS, fit_logistic, fold_models, prepared
from panelforge.schemas import FEATURES, RAW_PRICES
from panelforge.sources.layers import Layers, joined_by_asset, report, shuffles
from panelforge.sources.runs import RunSink
from panelforge.sources.tables import read_price_files
from panelforge.streaming.bars import market_bars, run_available
from tests.test_whole import DATA, agree

NEW = ("bucketed_dataset", "surprise_std_all", "run_appends", "prices_of_whole_files", "rejected_files", "market_bars_live", "auc_report", "orphan_message", "orphan_offenders", "validate_summary")


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    assert agree(spark, name)


# layers ---------------------------------------------------------------------------------------------
def test_stored_layers_join_without_a_shuffle(spark, tmp_path):
    p = Panel(spark, DATA)
    layers = Layers(spark, buckets=3, path=f"file://{tmp_path}")
    bucketed_panel(layers, p.bars(), p.assets)
    bars, features, labels, assets = (layers.read(n) for n in ("bars", "features", "labels", "assets"))
    with joined_by_asset(spark):
        for made in (features_daily(bars), labels_daily(bars, features), training_dataset(features, labels, assets)):
            assert shuffles(made) == 0
    assert shuffles(training_dataset(features_daily(p.bars()), labels_daily(p.bars(), features_daily(p.bars())), p.assets)) > 0


def test_a_layer_is_replaced(spark, tmp_path):
    layers = Layers(spark, buckets=2, path=f"file://{tmp_path}")
    for n in (5, 3):
        got = layers.store("x", spark.range(n).selectExpr("id as asset_id", "double('nan') as v"))
        assert (got.count(), got.where("v is null").count()) == (n, n)


def test_reports_are_ordered(spark):
    rows = spark.createDataFrame([(2, "b", 1), (1, "b", 2), (1, "a", 3)], "fold int, symbol string, x int")
    assert [r["x"] for r in report(rows).collect()] == [3, 2, 1]


# models ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def panel_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        for a in range(2):
            x = rng.standard_normal(6) * [1, 5, 0.01, 1, 2, 1] + a
            rows.append((a, date(2000, 1, 1) + timedelta(i), *map(float, x), bool(x[0] + rng.standard_normal() > 0), bool(x[3] + 2 * rng.standard_normal() > 1)))
    df = spark.createDataFrame(rows, "asset_id long, trading_date date, " + ", ".join(f"{f} double" for f in FEATURES) + ", y_up_next_day boolean, y_large_move_next boolean")
    return df.repartition(3).persist()


def test_models_fitted_together_are_those_fitted_apart(spark, panel_rows):
    folds = generate_folds(panel_rows, n_folds=3, embargo=5)
    rows = prepared(panel_rows, folds).where("role = 'train'")
    moments = {(r["fold"], r["feature"]): (r["mean"], r["std"]) for r in _scalers(panel_rows, folds)}
    for fold, *models in fold_models(panel_rows, folds):
        for (b, *w), target in zip(models, TARGETS.values(), strict=True):
            alone = fit_logistic(rows.where(F.col("fold") == fold), target, tol=1e-12)
            mean, spread = (np.array(x) for x in zip(*(moments[fold, f] for f in FEATURES), strict=True))
            assert np.allclose(np.array(w) * spread, alone.coefficients.toArray(), atol=1e-6)
            assert abs(b + np.array(w) @ mean - alone.intercept) < 1e-6


def _scalers(rows, folds):
    from panelforge.operators.folds import fold_scalers

    return fold_scalers(rows, folds, FEATURES).collect()


def test_jobs_do_not_grow_with_folds(spark, panel_rows):
    jobs = {}
    for n in (1, 6):
        folds = generate_folds(panel_rows, n_folds=n, embargo=5)
        spark.sparkContext.setJobGroup(f"fit {n}", "fit")
        fold_models(panel_rows, folds)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[6] <= jobs[1] + 6  # a few steps more, not six times as many


def test_one_class_is_named(spark, panel_rows):
    rows = panel_rows.withColumn("y_large_move_next", F.lit(False))
    with pytest.raises(ValueError, match="y_large_move_next has one class"):
        fold_models(rows, generate_folds(rows, n_folds=2, embargo=5))


# isotonic -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size,fan", [(100_000, 16), (5, 2), (1, 3)])
def test_isotonic_in_slices_is_isotonic(spark, monkeypatch, size, fan):
    monkeypatch.setattr(isotonic, "SLICE", size)
    monkeypatch.setattr(isotonic, "FAN_IN", fan)
    monkeypatch.setattr(isotonic, "BUCKETS", 64)
    rng = random.Random(size)
    rows = [(g, round(rng.random() ** 2, 3), rng.random() < 0.3 + 0.2 * g) for g in (0, 1, 2) for _ in range(400)] + [(0, None, True), (1, 0.5, None), (3, 0.4, True)]
    df = spark.createDataFrame(rows, "g int, p double, y boolean")
    pieces = isotonic.isotonic_map(isotonic.isotonic_blocks(df, "p", "y", ["g"]), ["g"])
    asked = [x / 200 for x in range(-10, 211)]
    got = {(r["g"], r["p"]): r["p_calibrated"] for r in isotonic.map_scores(spark.createDataFrame([(g, x) for g in range(5) for x in asked], "g int, p double"), pieces, "p", ["g"]).collect()}
    assert len(got) == 5 * len(asked) and all(got[4, x] is None for x in asked) and all(got[3, x] == 1.0 for x in asked)
    for g in (0, 1, 2):
        at, values = calibrate.fit_isotonic(df.where((F.col("g") == g) & F.col("p").isNotNull() & F.col("y").isNotNull()), "p", "y")
        assert np.allclose([got[g, x] for x in asked], np.interp(asked, at, values), atol=1e-9)


def test_isotonic_map_is_not_broadcast_by_force(spark):
    df = spark.createDataFrame([(1, 0.2, True), (1, 0.4, False)], "g int, p double, y boolean")
    plan = isotonic.map_scores(df, isotonic.isotonic_map(isotonic.isotonic_blocks(df, "p", "y", ["g"]), ["g"]), "p", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_platt_maps_fitted_together_are_those_fitted_apart(spark):
    rng = random.Random(9)
    rows = [(g, round(rng.uniform(0.02, 0.98), 3), rng.random() < rng.uniform(0.1, 0.5) * (g + 1) / 2) for g in (0, 1, 2) for _ in range(500)] + [(0, None, True), (1, 0.5, None)]
    df = spark.createDataFrame(rows, "g int, p double, y boolean")
    for g, a, b in calibrate.platt_maps(df, "p", "y", "g"):
        (want_a,), (want_b,) = calibrate.fit_platt(df.where((F.col("g") == g) & F.col("p").isNotNull() & F.col("y").isNotNull()), "p", "y")
        assert (a, b) == pytest.approx((want_a, want_b), abs=1e-5)
    with pytest.raises(ValueError, match="one class"):
        calibrate.platt_maps(df.where("y"), "p", "y", "g")


# the run sink ---------------------------------------------------------------------------------------
def _runs(spark, n=2):
    return spark.createDataFrame([(i, f"r{i}") for i in range(n)], "fold int, note string"), spark.createDataFrame([(i, j, float("nan") if j else 0.5) for i in range(n) for j in range(3)], "fold int, asset_id int, p double")


def test_appends_are_whole_or_not_there(spark, tmp_path):
    sink = RunSink(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="no run"):
        sink.runs()
    assert sink.append("a", *_runs(spark)) == [1, 2]
    sink.stage(*_runs(spark))  # the writer fails here
    assert sink.runs().count() == 2 and sink.predictions().count() == 6
    assert sink.append("b", *_runs(spark, 3)) == [3, 4, 5]
    assert sink.append("b", *_runs(spark, 3)) == [3, 4, 5] and sink.append("a", *_runs(spark)) == [1, 2]
    assert sorted((r["model_run_id"], r["note"]) for r in sink.runs().collect()) == [(1, "r0"), (2, "r1"), (3, "r0"), (4, "r1"), (5, "r2")]
    told = {(r["model_run_id"], r["fold"]): r["count"] for r in sink.predictions().groupBy("model_run_id", "fold").count().collect()}
    assert told == {(1, 0): 3, (2, 1): 3, (3, 0): 3, (4, 1): 3, (5, 2): 3}
    assert sink.predictions().where("p is null").count() == 10  # not a number becomes null


def test_racing_appends_take_different_ids(spark, tmp_path, monkeypatch):
    one, two = RunSink(spark, f"file://{tmp_path}"), RunSink(spark, f"file://{tmp_path}")
    staged = two.stage(*_runs(spark))
    read, seen = two.committed, []

    def late():
        found = read()
        if not seen:  # the other append commits after this one has read the log
            seen.append(one.append("one", *_runs(spark)))
        return found

    monkeypatch.setattr(two, "committed", late)
    assert two.commit("two", *staged) == [3, 4] and seen == [[1, 2]]
    assert sorted(r["model_run_id"] for r in one.runs().collect()) == [1, 2, 3, 4]


def test_runs_of_one_append_differ(spark, tmp_path):
    runs, preds = _runs(spark)
    with pytest.raises(ValueError, match="each once"):
        RunSink(spark, f"file://{tmp_path}").append("x", runs.union(runs), preds)


# market days ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("days", [(datetime(2024, 3, 8), 5), (datetime(2024, 11, 1), 5)])
def test_market_days_over_a_change_of_the_clock(spark, tmp_path, days):
    from zoneinfo import ZoneInfo

    rng, (begin, n) = random.Random(6), days
    ticks = sorted((begin + timedelta(seconds=rng.randrange(n * 86_400), microseconds=rng.randrange(10**6)), rng.randrange(3), rng.random(), i) for i in range(900))
    # The first and last instants of market days, too.
    ticks += [(begin + timedelta(hours=h), 1, 0.5, 1000 + h) for h in range(24 * n)] + [(begin + timedelta(days=n + 2), 9, 0.0, 5000)]
    spark.createDataFrame([(t, a, p, i) for t, a, p, i in ticks], "ts timestamp, asset_id int, price double, tick_id int").coalesce(1).write.parquet(f"{tmp_path}/in")
    declared = spark.read.parquet(f"{tmp_path}/in")
    live = run_available(market_bars(spark.readStream.schema(declared.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out").collect()
    want = {}
    for t, a, p, i in sorted(ticks, key=lambda r: (r[0], r[3])):
        day = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("America/New_York")).date()
        o, h, lo, _, k = want.get((a, day), (p, p, p, p, 0))
        want[a, day] = (o, max(h, p), min(lo, p), p, k + 1)
    last = max(d for _, d in want)
    assert {(r[0], r[1]): tuple(r[2:]) for r in live} == {k: v for k, v in want.items() if k[1] < last}
    assert {(r[0], r[1]): tuple(r[2:]) for r in market_bars(declared).collect()} == want


# files put aside ------------------------------------------------------------------------------------
def test_files_that_are_not_whole_are_put_aside(spark, tmp_path):
    names = ",".join(c.split()[0] for c in RAW_PRICES.split(", "))
    row = "A,2020-01-02,1.0,2.0,0.5,1.5,1.5,10,v"
    texts = {"good": f"{names}\n{row}\n{row}\n", "gaps": f"{names}\nA,2020-01-03,,,,,,,\n", "header": f"{names}\n", "torn": f"{names}\n{row}\nA,2020-01-0", "number": f"{names}\nA,2020-01-02,x,2,1,1,1,1,v\n{row}\n", "bare": f"{row}\n", "other": f"date,open\n{row}\n", "empty": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    good, files = read_price_files(spark, [f"file://{tmp_path}/{n}.csv" for n in texts], f"{tmp_path}/lines")
    told = {r["file"].rsplit("/", 1)[1][:-4]: (r["n_rows"], r["n_bad"], r["has_header"], r["accepted"]) for r in files.collect()}
    assert told == {"good": (2, 0, True, True), "gaps": (1, 0, True, True), "header": (0, 0, True, True), "torn": (2, 1, True, False), "number": (2, 1, True, False), "bare": (1, 0, False, False), "other": (2, 1, False, False), "empty": (0, 0, False, False)}
    assert sorted((r["trading_date"].day, r["close"]) for r in good.na.fill(0.0).collect()) == [(2, 1.5), (2, 1.5), (3, 0.0)]
    with pytest.raises(ValueError, match="whole file"):
        read_price_files(spark, [f"file://{tmp_path}/torn.csv", f"file://{tmp_path}/bare.csv"], f"{tmp_path}/other_lines")
    with pytest.raises(ValueError, match="no input"):
        read_price_files(spark, [], f"{tmp_path}/none")


# running moments ------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_moments_over_all_earlier_rows(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "SLICE", size)
    rows = spark.range(400).selectExpr("nullif(cast(id % 3 as string), '2') as event_type", "timestamp_seconds(id * 40000 % 9999999) as event_ts", "id as event_id", "if(id % 11 = 0, null, 1e6 + id * id % 97) as surprise")
    got = {r["event_id"]: r["surprise_std"] for r in events.standardised_surprise(rows).collect()}
    w = Window.partitionBy("event_type").orderBy("event_ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["event_id"]: r["s"] for r in rows.withColumn("s", F.try_divide("surprise", F.stddev_samp("surprise").over(w))).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] / want[k] - 1) < 1e-9) for k in want)


# checks in one pass ---------------------------------------------------------------------------------
def test_prices_are_read_once(spark):
    plan = entry.queries()["validate_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "lineitem.parquet" in line for line in plan.splitlines()) == 1


def test_one_pass_counts_what_is_wrong(spark):
    day = date(2020, 1, 1)
    price = lambda s, d, close=1.0, low=0.5, high=2.0: (s, d, 1.0, high, low, close, close, 1.0, "t")
    rows = [price("A", day), price("A", day), price("A", day + timedelta(1), -1.0), price("B", None), price(" ", day), price("C", date(2030, 1, 1)), price("C", day, low=3.0), price("D", day, 7.0), price("E", day, 7.0), price(None, day)]
    assets = [("A",), ("B",), ("C",), ("D",), ("F",), ("F",), ("",), (None,)]
    event = [("e", datetime(2020, 1, 1), None), ("", None, None)]
    summary = validate.validate(
        spark.createDataFrame(assets, "symbol string"), spark.createDataFrame(rows, RAW_PRICES), spark.createDataFrame(event, "event_type string, event_ts timestamp, event_date date"), day
    )
    # F twice, the empty symbol and the null one have no prices; E and the blank symbol are no asset's.
    want = {"missing_keys": 3, "negative_values": 1, "inverted_range": 1, "future_dates": 1, "duplicate_prices": 1, "duplicate_series": 2, "blank_symbols": 2, "duplicate_symbols": 1, "assets_without_prices": 4, "orphan_prices": 2, "blank_event_types": 1, "undated_events": 1}
    assert {r["check"]: r["n_violations"] for r in summary.collect()} == want
    with pytest.raises(ValueError, match="orphan_prices: 2"):
        validate.require_valid(summary)


def test_messages_hold_a_bounded_number_of_offenders(spark):
    rows = spark.range(1000).selectExpr("lpad(cast((id * 7919) % 1000 as string), 4, '0') as s")
    got = validate.offender_message(rows, "s", "bad", 3).first()
    assert (got["n_offenders"], got["message"]) == (1000, "bad: 0000, 0001, 0002 and 997 more")
    assert validate.offender_message(rows.limit(0), "s", "bad").first()["message"] == "bad: none"
    assert validate.offender_message(rows.limit(0).union(spark.createDataFrame([("x",), (None,)], "s string")), "s", "bad").first()["message"] == "bad: x"
    assert "TakeOrderedAndProject" in validate.offender_list(rows, "s", 3)._jdf.queryExecution().executedPlan().toString()


def test_every_offender_is_listed(spark):
    rows = spark.range(1000).selectExpr("lpad(cast((id * 7919) % 1000 as string), 4, '0') as s").union(spark.createDataFrame([(None,)] * 5, "s string"))
    assert tuple(validate.offender_list(rows, "s").first()) == (", ".join(f"{i:04}" for i in range(1000)), 1000)
    assert tuple(validate.offender_list(rows, "s", 2).first()) == ("0000, 0001", 1000)
    for n in (None, 3):
        assert tuple(validate.offender_list(rows.limit(0), "s", n).first()) == (None, 0)


@pytest.mark.parametrize(("first", "n"), [(0, 6000), (1, 9)])
def test_orphans_of_many_assets_or_none_are_those_of_sql(spark, tmp_path, first, n):
    """Every fiftieth asset has a copied series; the ten suppliers of the tables repeat under further keys."""
    con = duckdb.connect()
    number = f"(s_suppkey + 10 * i + {first})"
    con.execute(f"COPY (SELECT CAST({number} AS BIGINT) AS s_suppkey, printf('Supplier#%09d', {number}) AS s_name, s_nationkey FROM '{DATA}/supplier.parquet', range(600) r(i) WHERE s_suppkey + 10 * i < {n}) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CAST(l_suppkey + 10 * (l_orderkey % 600) AS BIGINT) AS l_suppkey) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for t in ("orders", "customer", "nation", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    listed = agree(spark, "orphan_offenders", tmp_path)[0]["offenders"]
    assert listed is None if first else listed.count(", ") > 50


def test_auc_at_several_levels_from_one_count(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(2), round(rng.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "f string, s string, y int, p double")
    levels = [["f"], ["f", "s"], []]
    both = evaluate.auc_levels(df, "y", "p", levels)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan ExistingRDD") == 1
    got = {(r["level"], r["f"], r["s"]): (round(r["auc"], 9), r["n_pos"], r["n_neg"]) for r in both.collect()}
    want = {}
    for i, by in enumerate(levels):
        for r in evaluate.auc(df, "y", "p", by).collect():
            want[i, r["f"] if "f" in by else None, r["s"] if "s" in by else None] = (round(r["auc"], 9), r["n_pos"], r["n_neg"])
    assert got == want and len(got) == 2 + 6 + 1


def test_bonferroni_keeps_the_family_at_its_level():
    assert evaluate.bonferroni(0.05, 10) == pytest.approx(0.005)
    assert 1 - (1 - evaluate.bonferroni(0.05, 20)) ** 20 < 0.05
