"""Backtests: positions, turnover costs, equal-weight daily portfolios, equity curves, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.columns import position_always_long, position_direction, position_large_move

TRADING_DAYS = 252
COST_BPS = 1.5
ROLLING = 60

#: Name to a position from prediction columns.
STRATEGIES: dict[str, Callable[[], Column]] = {"direction_threshold": position_direction, "large_move_filter": position_large_move, "always_long": position_always_long}


def positions(preds: DataFrame, strategies: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
    """Each prediction once for each strategy, with its position."""
    rules = F.array(*[F.struct(F.lit(n).alias("strategy"), STRATEGIES[n]().cast("double").alias("position")) for n in strategies])
    return preds.select("*", F.inline(rules))


def turnover(pos: DataFrame, run: str = "fold") -> DataFrame:
    """Change of position from the asset's row before; the first one enters from cash."""
    w = Window.partitionBy("asset_id", run, "strategy").orderBy("trading_date")
    return pos.withColumn("turnover", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)))


def daily_portfolio(pos: DataFrame, costs: Sequence[float] = (COST_BPS,), run: str = "fold") -> DataFrame:
    """Equal-weight means by run, strategy, cost and day.  A cost acts on means as on rows, so it is applied after the aggregation."""
    gross = F.col("position") * F.col("ret_fwd_1d")
    daily = turnover(pos, run).groupBy(run, "strategy", "trading_date").agg(
        F.avg("position").alias("avg_position"),
        F.avg("turnover").alias("turnover"),
        F.avg(gross).alias("gross_return"),
        F.count_if(F.col("position") != 0).alias("n_active"),
        F.count_if(F.col("turnover") > 0).alias("n_trades"),
    )
    priced = daily.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    return priced.withColumn("net_return", F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 10000)


def equity_curve(daily: DataFrame, run: str = "fold", n: int = ROLLING) -> DataFrame:
    """Compounded return, drawdown from a peak of at least the starting capital, and rolling metrics of full windows."""
    w = Window.partitionBy(run, "strategy", "cost_bps").orderBy("trading_date")
    whole, recent = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - n, 0)
    net = F.col("net_return")
    full = F.count(net).over(recent) == n
    return (
        daily.withColumn("__equity", F.product(1 + net).over(whole))
        .withColumns(
            {
                "cum_return": F.col("__equity") - 1,
                "drawdown": F.col("__equity") / F.greatest(F.max("__equity").over(whole), F.lit(1.0)) - 1,
                "hit_rate_rolling": F.when(full, F.avg((net > 0).cast("int")).over(recent)),
                "sharpe_rolling": F.when(full, F.try_divide(F.sqrt(F.lit(TRADING_DAYS)) * F.avg(net).over(recent), F.stddev_samp(net).over(recent))),
            }
        )
        .drop("__equity")
    )


def summarize(curve: DataFrame, run: str = "fold") -> DataFrame:
    """Whole-period metrics; hit rate and expectancy over days with exposure only."""
    net, active = F.col("net_return"), F.col("n_active") > 0
    mean_of = lambda c: F.avg(F.when(c, net))
    hit = F.avg(F.when(active, (net > 0).cast("int")))
    return curve.groupBy(run, "strategy", "cost_bps").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("n_trades").alias("n_trades"),
        F.max_by("cum_return", "trading_date").alias("total_return"),
        F.try_divide(F.sqrt(F.lit(TRADING_DAYS)) * F.avg(net), F.stddev_samp(net)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        hit.alias("hit_rate"),
        (hit * mean_of(active & (net > 0)) - (1 - hit) * F.abs(mean_of(active & (net < 0)))).alias("expectancy"),
    )


def versus_benchmark(summary: DataFrame, benchmark: str = "always_long") -> DataFrame:
    """Means over runs by strategy and cost, and the differences to the benchmark strategy."""
    means = summary.groupBy("strategy", "cost_bps").agg(
        *[F.avg(c).alias(c) for c in ("sharpe", "total_return", "max_drawdown", "hit_rate")], F.sum("n_trades").alias("n_trades")
    )
    base = means.where(F.col("strategy") == benchmark).select("cost_bps", F.col("sharpe").alias("b_sharpe"), F.col("total_return").alias("b_total"))
    joined = means.join(F.broadcast(base), "cost_bps", "left")
    return joined.withColumns({"d_sharpe": F.col("sharpe") - F.col("b_sharpe"), "d_total": F.col("total_return") - F.col("b_total")}).drop("b_sharpe", "b_total")


def cost_sensitivity(pos: DataFrame, costs: Sequence[float] = (0.0, 1.5, 5.0), run: str = "fold") -> DataFrame:
    """Mean metrics by strategy and cost over identical positions, in one job."""
    return versus_benchmark(summarize(equity_curve(daily_portfolio(pos, costs, run), run), run))


def latest_backtests(runs: DataFrame, cost_bps: float = COST_BPS) -> DataFrame:
    """The newest backtest of each model run and strategy at a cost."""
    at = runs.where(F.col("cost_bps") == cost_bps)
    return at.groupBy("model_run_id", "strategy").agg(F.max("backtest_run_id").alias("backtest_run_id"))


def backtest_series(runs: DataFrame, results: DataFrame, cost_bps: float = COST_BPS) -> DataFrame:
    """Daily results of the newest backtests."""
    return results.join(latest_backtests(runs, cost_bps), "backtest_run_id")
