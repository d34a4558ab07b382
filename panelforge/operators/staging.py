"""Raw tables to staged ones: defaults, surrogate keys, settled sessions, event surprises."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_assets(raw_assets: DataFrame) -> DataFrame:
    """Defaults for missing attributes, and ids in symbol order.  The asset dimension is small; its ids need one order."""
    return raw_assets.select(
        F.row_number().over(Window.orderBy("symbol")).cast("long").alias("asset_id"),
        "symbol",
        "name",
        F.coalesce("asset_type", F.lit("etf")).alias("asset_type"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        "exchange",
        "source",
    )


def stage_prices(raw_prices: DataFrame, assets: DataFrame) -> DataFrame:
    """Prices by asset id; symbols without an asset go."""
    keys = assets.select("symbol", "asset_id")
    return raw_prices.join(keys, "symbol").select("asset_id", "trading_date", "open", "high", "low", "close", "adj_close", "volume", "source")


def market_date(now: datetime | Column, tz: str = "America/New_York") -> Column:
    """The market's date at an instant; a naive datetime is UTC."""
    at = now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp")
    return F.to_date(F.from_utc_timestamp(at, tz))


def settled_bars(bars: DataFrame, now: datetime | Column, tz: str = "America/New_York") -> DataFrame:
    """Bars of sessions before the market's current date, so that any two runs on one market day agree."""
    return bars.where(F.col("trading_date") < market_date(now, tz))


def stage_events(raw_events: DataFrame) -> DataFrame:
    """A date for every event, and its surprise."""
    surprise = F.col("actual") - F.col("forecast")
    return raw_events.withColumns(
        {
            "event_date": F.coalesce("event_date", F.to_date("event_ts")),
            "surprise": surprise,
            "surprise_pct": F.try_divide(surprise, F.abs("forecast")),
            "cleaned_text": F.trim("raw_text"),
        }
    ).drop("raw_text")


def event_asset_map(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Every event to every asset, at weight one.  The table is their product by definition; join market-wide events by date instead where possible."""
    return events.select("event_id").crossJoin(F.broadcast(assets.select("asset_id"))).withColumn("weight", F.lit(1.0))


def map_events(events: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """Events to the assets that explicit rules give, weights normalised within each event."""
    hit = events.select(key).join(rules.groupBy(key, "asset_id").agg(F.sum("weight").alias("weight")), key)
    return hit.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy(key))))
