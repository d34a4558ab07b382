"""Every operator as a query over the given tables.  Doubles are rounded, as sums depend on order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.columns import bin_index, fill_price, longest_lookback, position_proportional
from panelforge.operators import assertions, backtest, calibrate, evaluate, events, staging, validate
from panelforge.operators.dataset import panel, trading_calendar, training_dataset
from panelforge.operators.features import features_daily
from panelforge.operators.folds import embargo_reach, fold_scalers, generate_folds, split
from panelforge.operators.labels import labels_daily
from panelforge.operators.model import fixed_predictions, model_runs, prepared, walk_forward
from panelforge.schemas import FEATURES, LABELS, RAW_EVENTS
from panelforge.sources import fixtures
from panelforge.sources.layers import Layers
from panelforge.sources.scratch import scratch_path
from panelforge.sources.runs import RunSink
from panelforge.sources.tables import nan_to_null, normalize_prices, read_assets, read_events, read_price_files, read_prices, table, write_layer
from panelforge.streaming.bars import bars_of, dedupe_bars, market_bars, run_available, stream_bars

PLACES = 8
AS_OF = date(2000, 6, 15)
#: One hour after midnight in UTC: still the day before in the market.
NOW = datetime(2000, 6, 15, 1, 0)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


class Panel:
    """The tables that queries build on, for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw_assets = fixtures.raw_assets(spark, sf_dir)
        self.raw_prices = fixtures.raw_prices(spark, sf_dir)
        self.assets = staging.stage_assets(self.raw_assets)
        self._stored: DataFrame | None = None

    def bars(self) -> DataFrame:
        return staging.stage_prices(self.raw_prices, self.assets)

    def dataset(self) -> DataFrame:
        return panel(self.bars(), self.assets)

    def stored(self) -> DataFrame:
        """The training dataset as a layer by asset, written once: folds read its dates, the rest its rows."""
        if self._stored is None:
            self._stored = Layers(self.spark).store("dataset", self.dataset())
        return self._stored

    def folds(self) -> DataFrame:
        return generate_folds(self.stored())

    def predictions(self) -> DataFrame:
        """Fixed-coefficient predictions of every fold's test rows, labels beside them."""
        return fixed_predictions(split(self.stored(), self.folds()).where("role = 'test'"))

    def positions(self) -> DataFrame:
        return backtest.positions(self.predictions()).select("fold", "asset_id", "trading_date", "strategy", "position", "ret_fwd_1d")

    def curve(self) -> DataFrame:
        return backtest.equity_curve(backtest.daily_portfolio(self.positions()))

    def summary(self) -> DataFrame:
        return backtest.summarize(self.curve())

    def events(self) -> DataFrame:
        return staging.stage_events(fixtures.raw_events(self.spark, self.sf_dir))

    def calendar(self) -> DataFrame:
        return trading_calendar(self.raw_prices)

    def sessions(self) -> DataFrame:
        """Staged events with their effective session; a stated date counts as the source gave it."""
        raw = fixtures.raw_events(self.spark, self.sf_dir)
        surprise = staging.stage_events(raw).select("event_id", "surprise")
        return events.effective_session(raw.drop("raw_text"), self.calendar()).join(surprise, "event_id")

    def backtest_runs(self) -> DataFrame:
        """Two backtests of every fold and strategy; the later one replaces the earlier."""
        once = self.summary().select(F.col("fold").cast("long").alias("model_run_id"), "strategy", "cost_bps")
        code = F.when(F.col("strategy") == "always_long", 1).when(F.col("strategy") == "direction_threshold", 2).otherwise(3)
        return once.withColumn("backtest_run_id", F.explode(F.array(F.col("model_run_id") * 10 + code, 1000 + F.col("model_run_id") * 10 + code)))


def _on(build: Callable[[Panel], DataFrame], places: int = PLACES) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(build(Panel(spark, sf_dir)), places)


def _copied(p: Panel) -> DataFrame:
    """Prices with the series of every fiftieth asset under a second symbol."""
    own = F.array("symbol")
    both = F.when(F.substring("symbol", -2, 2).isin("00", "50"), F.array_append(own, F.concat(F.lit("COPY "), "symbol"))).otherwise(own)
    return p.raw_prices.withColumn("symbol", F.explode(both))


def _orphan_symbols(p: Panel) -> DataFrame:
    return validate.orphans(_copied(p).select("symbol").distinct(), p.raw_assets, "symbol")


def _validated(p: Panel) -> DataFrame:
    return validate.validate(_with_customers(p), _copied(p), fixtures.raw_events(p.spark, p.sf_dir), AS_OF)


def _declared(p: Panel) -> DataFrame:
    """Every declared rule over the whole tables; prices include copied series, whose symbols are no asset's."""
    features, runs = features_daily(p.bars()), p.backtest_runs()
    key = runs.select(F.col("model_run_id").cast("int").alias("fold"), "strategy", "cost_bps", "model_run_id", "backtest_run_id")
    return validate.declared_violations(
        {
            "raw_assets": p.raw_assets,
            "raw_prices": _copied(p),
            "assets": p.assets,
            "prices": p.bars(),
            "events": p.events(),
            "event_asset_map": _event_map(p),
            "features": features,
            "labels": labels_daily(p.bars(), features),
            "model_runs": model_runs(p.folds()),
            "predictions": p.predictions().withColumn("model_run_id", F.col("fold").cast("long")),
            "backtest_runs": p.summary().join(key, ["fold", "strategy", "cost_bps"]),
            "backtest_results": p.curve().join(key, ["fold", "strategy", "cost_bps"]),
        }
    )


def _with_customers(p: Panel) -> DataFrame:
    """Assets with one for each customer beside the suppliers': none of those has a price."""
    customers = table(p.spark, p.sf_dir, "customer").select(F.col("c_name").alias("symbol"), F.col("c_name").alias("name"), F.lit("customer").alias("source"))
    return p.raw_assets.unionByName(customers, allowMissingColumns=True)


def _scored(join: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Callable[[Panel], DataFrame]:
    """Every run's predictions joined to the labels of all bars."""
    def build(p: Panel) -> DataFrame:
        preds = evaluate.select_runs(p.predictions()).select("fold", "asset_id", "trading_date", "p_up", "p_large_move")
        labels = labels_daily(p.bars(), features_daily(p.bars())).select("asset_id", "trading_date", *LABELS)
        return join(preds, labels, p.assets).select("fold", "symbol", "trading_date", "p_up", "p_large_move", "ret_fwd_1d", "y_up_next_day", "y_large_move_next")

    return build


def _backtest_series(p: Panel) -> DataFrame:
    """Both backtests' daily results, of which the later one's stay."""
    runs = p.backtest_runs()
    key = runs.select(F.col("model_run_id").cast("int").alias("fold"), "strategy", "cost_bps", "backtest_run_id")
    results = p.curve().join(key, ["fold", "strategy", "cost_bps"]).select("backtest_run_id", "trading_date", "net_return", "cum_return")
    return backtest.backtest_series(runs, results)


def _aucs(p: Panel, *by: str) -> DataFrame:
    """Both targets of each prediction as rows, so that predictions are made once."""
    of = lambda target, y, score: F.struct(F.lit(target).alias("target"), F.col(y).alias("y"), F.col(score).alias("score"))
    both = F.array(of("up", "y_up_next_day", "p_up"), of("large_move", "y_large_move_next", "p_large_move"))
    return evaluate.auc(p.predictions().select(*by, F.inline(both)), "y", "score", [*by, "target"])


def _auc_report(p: Panel) -> DataFrame:
    """Both targets' AUC pooled, by fold, and by fold and symbol, from one count of the scores."""
    of = lambda target, y, score: F.struct(F.lit(target).alias("target"), F.col(y).alias("y"), F.col(score).alias("score"))
    both = F.array(of("up", "y_up_next_day", "p_up"), of("large_move", "y_large_move_next", "p_large_move"))
    rows = p.predictions().select("fold", "symbol", F.inline(both))
    named = F.element_at(F.array(*map(F.lit, ("pooled", "fold", "symbol"))), F.col("level") + 1)
    levels = evaluate.auc_levels(rows, "y", "score", [["target"], ["target", "fold"], ["target", "fold", "symbol"]])
    return levels.withColumns({"level": named, "fold": F.coalesce("fold", F.lit(0)), "symbol": F.coalesce("symbol", F.lit("all"))})


def _symbol_summary(p: Panel) -> DataFrame:
    aucs = _aucs(p, "fold", "symbol")
    return evaluate.symbol_distribution(aucs.where("target = 'up'"), aucs.where("target = 'large_move'"))


def _baseline(p: Panel) -> DataFrame:
    dataset = p.stored()
    return evaluate.naive_baseline(fixed_predictions(split(dataset, p.folds())))


def _embargo(p: Panel) -> DataFrame:
    dataset = p.stored()
    return embargo_reach(dataset, p.folds(), longest_lookback(FEATURES))


def _split_counts(p: Panel) -> DataFrame:
    dataset = p.stored()
    return split(dataset, p.folds()).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))


def _scalers(p: Panel) -> DataFrame:
    dataset = p.stored()
    return fold_scalers(dataset, p.folds(), FEATURES)


def _joined_dataset(p: Panel) -> DataFrame:
    features = features_daily(p.bars())
    return training_dataset(features, labels_daily(p.bars(), features), p.assets)


def _assert_pair(check: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[Panel], DataFrame]:
    def build(p: Panel) -> DataFrame:
        features = features_daily(p.bars())
        return check(features, labels_daily(p.bars(), features))

    return build


def _out_of_sample(p: Panel) -> DataFrame:
    dataset = p.stored()
    folds = p.folds()
    return assertions.assert_out_of_sample(fixed_predictions(split(dataset, folds).where("role = 'test'")), folds)


def _event_features(p: Panel) -> DataFrame:
    distances = events.event_distance(p.calendar(), p.sessions())
    return events.event_features(p.dataset().select("asset_id", "trading_date", "mom_20d"), distances)


def _event_map(p: Panel) -> DataFrame:
    """Orders as events, weighted by their lines' suppliers."""
    lines = table(p.spark, p.sf_dir, "lineitem")
    keys = table(p.spark, p.sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol")).join(p.assets, "symbol")
    rules = lines.join(keys, "l_suppkey").select(F.col("l_orderkey").alias("event_id"), "asset_id", F.col("l_extendedprice").alias("weight"))
    return staging.map_events(fixtures.raw_events(p.spark, p.sf_dir), rules)


def _event_slice(p: Panel) -> DataFrame:
    """Event days of each type against its other days."""
    flags = events.event_distance(p.calendar(), p.sessions())
    return evaluate.event_day_slice(p.predictions(), flags, "y_large_move_next", "p_large_move", ["event_type"])


def _paired(p: Panel) -> DataFrame:
    """The direction model against its reversal by the large-move score."""
    rows = p.predictions()
    return evaluate.paired_deltas(evaluate.auc(rows, "y_up_next_day", "p_up", ["fold"]), evaluate.auc(rows, "y_up_next_day", "p_large_move", ["fold"]))


def _proportional(p: Panel) -> DataFrame:
    """Proportional sizing with filled prices, by fold."""
    rows = p.predictions().withColumns({"position": position_proportional(2.0), "bin": bin_index(F.col("p_up"))})
    fill = fill_price(F.lit(100.0), F.col("position"))
    return rows.groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("position").alias("avg_position"), F.avg(fill).alias("avg_fill"))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Panel(spark, sf_dir)
    dataset = p.stored()
    return rounded(walk_forward(dataset, p.folds()), 6)


def _calibrated(calibrated: Callable[[DataFrame, str, str], DataFrame]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The large-move score of every fold, calibrated on the latest slice of the fold's training rows."""
        p = Panel(spark, sf_dir)
        rows = fixed_predictions(split(p.stored(), p.folds())).select("fold", "role", "trading_date", "p_large_move", "y_large_move_next")
        test = calibrated(rows, "p_large_move", "y_large_move_next")
        raw = evaluate.brier(test, "y_large_move_next", "p_large_move", ["fold"]).withColumnRenamed("brier", "brier_raw")
        return rounded(raw.join(evaluate.brier(test, "y_large_move_next", "p_calibrated", ["fold"]).withColumnRenamed("brier", "brier_calibrated"), "fold"), 6)

    return query


def bucketed_panel(layers: Layers, bars: DataFrame, assets: DataFrame) -> DataFrame:
    """The training dataset through stored layers of bars, features and labels: rows are shuffled once, into the bars' buckets."""
    bars, assets = layers.store("bars", bars), layers.store("assets", assets)
    features = layers.store("features", features_daily(bars), deal=False)
    labels = layers.store("labels", labels_daily(bars, features).select("asset_id", "trading_date", *LABELS), deal=False)
    return layers.store("dataset", training_dataset(features, labels, assets), deal=False)


def _stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled days of the tick table: the stream's result in batch form, all days but the last."""
    bars = bars_of(fixtures.ticks(spark, sf_dir))
    last = bars.agg(F.max("trading_date").alias("last"))
    return rounded(bars.join(F.broadcast(last), F.col("trading_date") < F.col("last")).drop("last"))


def _stream_bars_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settled days as the watermarked stream gives them."""
    return rounded(run_available(stream_bars(fixtures.tick_stream(spark, sf_dir)), scratch_path(spark, "stream")))


def _stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an asset ticked, of a stream that repeats each for every tick."""
    days = fixtures.tick_stream(spark, sf_dir).select("asset_id", F.to_date("ts").alias("trading_date"), F.date_trunc("day", "ts").alias("ts"))
    return run_available(dedupe_bars(days), scratch_path(spark, "stream")).select("asset_id", "trading_date")


def _through_csv(build: Callable[[Panel], DataFrame], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[Panel], DataFrame]:
    """A raw table written as CSV and read by its declared schema."""

    def stored(p: Panel) -> DataFrame:
        path = scratch_path(p.spark, "raw")
        build(p).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return read(p.spark, path)

    return stored


def _raw_events(p: Panel) -> DataFrame:
    lacking = {c: F.lit(None).cast("string") for c in ("title", "country", "source")}
    columns = [c.split()[0] for c in RAW_EVENTS.split(", ")]
    return fixtures.raw_events(p.spark, p.sf_dir).withColumns(lacking).select(*columns)


def _vendor_prices(p: Panel) -> DataFrame:
    """Order lines of one day and supplier as a vendor's frame: one bar each, not a number where a discount is zero."""
    price = lambda c: F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col(c))
    lines = table(p.spark, p.sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("Date"), *[F.col("l_extendedprice").alias(c) for c in ("Open", "High", "Low", "Close")], price("l_extendedprice").alias("Adj Close"), F.col("l_quantity").alias("Volume")
    )
    bars = nan_to_null(normalize_prices(lines, "LINES", "vendor"))
    return bars.groupBy("symbol", "source", "trading_date").agg(F.count(F.lit(1)).alias("n"), F.count("adj_close").alias("n_adjusted"), F.max("high").alias("high"), F.sum("volume").alias("volume"))


def _stored_layer(p: Panel) -> DataFrame:
    """Features written as a layer, twice, of which the second stays."""
    path = scratch_path(p.spark, "layer")
    for _ in range(2):
        write_layer(features_daily(p.bars()), path)
    return p.spark.read.parquet(path)


def _appended(p: Panel) -> RunSink:
    """A sink after two appends of every fold's run; of the second one try failed before its commit, and one came again after it."""
    sink = RunSink(p.spark, scratch_path(p.spark, "runs"))
    runs = model_runs(p.folds()).withColumn("fold", F.col("model_run_id").cast("int")).drop("model_run_id")
    preds = p.predictions().select("fold", "asset_id", "trading_date", "p_up", "p_large_move", "signal")
    sink.append("first", runs, preds)
    sink.stage(runs, preds)
    for _ in range(2):
        sink.append("second", runs, preds)
    return sink


def _run_appends(p: Panel) -> DataFrame:
    """Every committed run with its provenance and what its predictions are."""
    sink = _appended(p)
    told = sink.predictions().groupBy("model_run_id").agg(F.count(F.lit(1)).alias("n_predictions"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.avg("p_up").alias("mean_p_up"))
    return sink.runs().drop("created_at", "fold").join(told, "model_run_id")


def _stored_runs(p: Panel) -> DataFrame:
    """The second append's runs as the sink gives them, joined to labels and backtested."""
    sink = _appended(p)
    ids = sink.append("second", p.folds(), p.predictions())
    chosen = evaluate.select_runs(sink.predictions(), ids)
    labels = labels_daily(p.bars(), features_daily(p.bars())).select("asset_id", "trading_date", "ret_fwd_1d")
    scored = evaluate.scored_predictions(chosen, labels, p.assets).withColumn("fold", F.col("model_run_id").cast("int"))
    positions = backtest.positions(scored).select("fold", "asset_id", "trading_date", "strategy", "position", "ret_fwd_1d")
    return backtest.summarize(backtest.equity_curve(backtest.daily_portfolio(positions))).withColumnRenamed("fold", "model_run_id")


def _price_files(p: Panel) -> tuple[DataFrame, DataFrame]:
    """A file of prices for each symbol, as vendors send them: those of symbols ending in 3 have a line that is none, those in 7 no header."""
    path, last = scratch_path(p.spark, "files"), F.substring("symbol", -1, 1)
    names = p.raw_prices.columns
    lines = p.raw_prices.select(*[F.col(c).cast("string") for c in names], F.col("symbol").alias("file"))
    symbols = p.assets.where(last == "3").select("symbol", F.lit("no date").alias("trading_date"), *[F.lit("x").alias(c) for c in names[2:]], F.col("symbol").alias("file"))
    dealt = lines.unionByName(symbols).repartition("file")
    for part, header in ((dealt.where(last != "7"), True), (dealt.where(last == "7"), False)):
        part.write.mode("append").partitionBy("file").csv(path, header=header)
    return read_price_files(p.spark, [path], scratch_path(p.spark, "lines") + "/rows")


def _rejected_files(p: Panel) -> DataFrame:
    files = _price_files(p)[1].where("not accepted")
    return files.select(F.url_decode(F.url_decode(F.regexp_extract("file", "/file=([^/]*)/", 1))).alias("symbol"), "n_rows", "n_bad", "has_header")


def _market_bars_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled days of the market as the watermarked stream gives them; the month of ticks is stretched over a year, with both changes of the clock."""
    begin = datetime(2024, 1, 1)
    micros = F.unix_micros(F.lit(begin.isoformat(sep=" ")).cast("timestamp"))
    ticks = fixtures.tick_stream(spark, sf_dir).withColumn("ts", F.timestamp_micros(micros + (F.unix_micros("ts") - micros) * 12))
    return rounded(run_available(market_bars(ticks), scratch_path(spark, "stream")))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over standardised training features: near zero by construction."""
    p = Panel(spark, sf_dir)
    dataset = p.stored()
    rows = prepared(dataset, p.folds()).where("role = 'train'")
    return rounded(rows.groupBy("fold").agg(*[F.avg(f).alias(f) for f in FEATURES]), 6).withColumns({f: F.abs(F.col(f)) for f in FEATURES})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "asset_dim": _on(lambda p: p.assets),
    "bars": _on(lambda p: p.bars()),
    "features_daily": _on(lambda p: features_daily(p.bars())),
    "labels_daily": _on(lambda p: labels_daily(p.bars(), features_daily(p.bars())).select("asset_id", "trading_date", *LABELS)),
    "training_dataset": _on(lambda p: p.dataset()),
    "training_dataset_joined": _on(_joined_dataset),
    "bucketed_dataset": _on(lambda p: bucketed_panel(Layers(p.spark), p.bars(), p.assets)),
    "settled_bars": _on(lambda p: staging.settled_bars(p.bars(), NOW).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.max("trading_date").alias("last_date"))),
    "validate_summary": _on(_validated),
    "declared_violations": _on(_declared),
    "dup_keys": _on(lambda p: validate.duplicate_keys(table(p.spark, p.sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])),
    "duplicate_series": _on(lambda p: validate.duplicate_series(_copied(p))),
    "assets_without_prices": _on(lambda p: validate.assets_without_prices(_with_customers(p), p.raw_prices).select("symbol", "name")),
    "inverted_and_future": _on(lambda p: validate.future_dates(p.raw_prices, AS_OF).unionByName(validate.inverted_range(p.raw_prices)).select("symbol", "trading_date", "close")),
    "orphan_offenders": _on(lambda p: validate.offender_list(_orphan_symbols(p), "symbol").select("offenders")),
    "orphan_message": _on(lambda p: validate.offender_message(_orphan_symbols(p), "symbol", "orphan prices", 1)),
    "embargo_reach": _on(_embargo),
    "folds": _on(lambda p: p.folds()),
    "rolling_folds": _on(lambda p: generate_folds(p.stored(), train_window=500)),
    "fold_split_counts": _on(_split_counts),
    "fold_scalers": _on(_scalers),
    "predictions_fixed": _on(lambda p: p.predictions().select("fold", "asset_id", "trading_date", "p_up", "p_large_move", F.col("signal").cast("int").alias("signal")), 9),
    "positions": _on(lambda p: backtest.turnover(p.positions()).select("fold", "asset_id", "trading_date", "strategy", "position", "turnover")),
    "daily_portfolio": _on(lambda p: p.curve()),
    "backtest_summary": _on(lambda p: p.summary()),
    "strategy_vs_benchmark": _on(lambda p: backtest.versus_benchmark(p.summary())),
    "cost_sensitivity": _on(lambda p: backtest.cost_sensitivity(p.positions())),
    "latest_backtests": _on(lambda p: backtest.latest_backtests(p.backtest_runs())),
    "backtest_series": _on(_backtest_series),
    "model_runs": _on(lambda p: model_runs(p.folds()).drop("created_at")),
    "scored_predictions": _on(_scored(evaluate.scored_predictions)),
    "evaluation_rows": _on(_scored(evaluate.evaluation_rows)),
    "confusion": _on(lambda p: evaluate.confusion(p.predictions(), ["fold"])),
    "calibration_fixed": _on(lambda p: evaluate.calibration_fixed(p.predictions(), "p_up", "y_up_next_day", ["fold"])),
    "calibration_decile": _on(lambda p: evaluate.calibration_quantile(p.predictions(), "p_large_move", "y_large_move_next")),
    "naive_baseline": _on(_baseline),
    "auc_by_fold": _on(lambda p: _aucs(p, "fold")),
    "auc_by_symbol": _on(lambda p: _aucs(p, "fold", "symbol")),
    "auc_report": _on(_auc_report),
    "auc_summary": _on(lambda p: evaluate.fold_distribution(_aucs(p, "fold"), ["target"])),
    "auc_symbol_summary": _on(_symbol_summary),
    "paired_deltas": _on(_paired),
    "brier": _on(lambda p: evaluate.brier(p.predictions(), "y_large_move_next", "p_large_move", ["fold"])),
    "proportional_sizing": _on(_proportional),
    "assert_forward": _on(_assert_pair(assertions.assert_forward)),
    "assert_labels": _on(_assert_pair(assertions.assert_labels)),
    "assert_signs": _on(lambda p: assertions.assert_signs(features_daily(p.bars()))),
    "assert_no_nulls": _on(lambda p: assertions.assert_no_nulls(p.dataset())),
    "assert_row_counts": _on(lambda p: assertions.assert_row_counts(p.assets, p.bars(), p.dataset())),
    "assert_out_of_sample": _on(_out_of_sample),
    "assert_net_identity": _on(lambda p: assertions.assert_net_identity(p.curve())),
    "assert_events": _on(lambda p: assertions.assert_events(p.sessions(), p.calendar())),
    "events_staged": _on(lambda p: staging.stage_events(fixtures.raw_events(p.spark, p.sf_dir)).select("event_id", "event_type", "event_date", "previous", "surprise", "surprise_pct", "cleaned_text")),
    "event_asset_map": _on(lambda p: staging.event_asset_map(p.events(), p.assets)),
    "event_map_weighted": _on(_event_map),
    "event_effective_session": _on(lambda p: p.sessions().select("event_id", "event_type", "session")),
    "last_surprise_asof": _on(lambda p: events.last_event_asof(p.calendar(), p.sessions())),
    "surprise_std": _on(lambda p: events.standardised_surprise(staging.stage_events(fixtures.raw_events(p.spark, p.sf_dir)), 50).select("event_id", "surprise_std")),
    "event_day_distance": _on(lambda p: events.event_distance(p.calendar(), p.sessions())),
    "event_features": _on(_event_features),
    "event_car": _on(lambda p: events.event_car(features_daily(p.bars()), p.sessions())),
    "event_day_slice": _on(_event_slice),
    "scaled_training_means": _prepared,
    "logreg_walkforward": _model,
    "platt": _calibrated(calibrate.calibrate_platt),
    "isotonic": _calibrated(calibrate.calibrate_isotonic),
    "stream_bars": _stream_bars,
    "stream_bars_live": _stream_bars_live,
    "stream_days": _stream_days,
    "stored_assets": _on(_through_csv(lambda p: p.raw_assets, read_assets)),
    "stored_prices": _on(_through_csv(lambda p: p.raw_prices, read_prices)),
    "stored_events": _on(lambda p: _through_csv(_raw_events, read_events)(p).withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))),
    "vendor_prices": _on(_vendor_prices),
    "stored_layer": _on(_stored_layer),
    "stored_runs": _on(_stored_runs),
    "run_appends": _on(_run_appends),
    "prices_of_whole_files": _on(lambda p: _price_files(p)[0]),
    "rejected_files": _on(_rejected_files),
    "market_bars_live": _market_bars_live,
    "surprise_std_all": _on(lambda p: events.standardised_surprise(staging.stage_events(fixtures.raw_events(p.spark, p.sf_dir))).select("event_id", "surprise_std")),
}
