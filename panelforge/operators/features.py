"""Trailing features; nothing here looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import by_asset, drawdown, momentum, relative, rolling_vol
from panelforge.schemas import FEATURES


def with_features(bars: DataFrame) -> DataFrame:
    """Adds the six features; all windows share one partitioning and sort."""
    price, previous = F.col("adj_close"), F.lag("adj_close").over(by_asset())
    log_return: Column = F.when((previous > 0) & (price > 0), F.log(price / previous))
    first = bars.withColumns({"ret_1d": relative(price, previous), "logret_1d": log_return, "mom_5d": momentum(price, 5), "mom_20d": momentum(price, 20), "drawdown_60d": drawdown(price, 60)})
    return first.withColumn("vol_20d", rolling_vol(F.col("logret_1d"), 20))


def features_daily(bars: DataFrame) -> DataFrame:
    return with_features(bars).select("asset_id", "trading_date", *FEATURES)
