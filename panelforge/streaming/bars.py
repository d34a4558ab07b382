"""Daily bars from a stream of ticks: only settled days, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "1 hour"


def bars_of(ticks: DataFrame, tz: str = "UTC") -> DataFrame:
    """asset_id, trading_date, open, high, low, close, n_ticks by market day; order within a day is (ts, tick_id)."""
    order = F.struct("ts", "tick_id")
    local = ticks if tz == "UTC" else ticks.withColumn("ts", F.from_utc_timestamp("ts", tz))
    grouped = local.groupBy(F.window("ts", "1 day").alias("day"), "asset_id").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n_ticks")
    )
    return grouped.select("asset_id", F.to_date(F.col("day.start")).alias("trading_date"), "open", "high", "low", "close", "n_ticks")


def stream_bars(ticks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """In append mode a day's bar appears once, after the watermark passes its end; later ticks of it are dropped."""
    return bars_of(ticks.withWatermark("ts", watermark))


def market_bars(ticks: DataFrame, tz: str = "America/New_York", watermark: str = WATERMARK) -> DataFrame:
    """The same by the days of a market, also on those of 23 or 25 hours; the watermark stays on the ticks' own time.

    A tick opens a session that lasts to the end of its market day, so a day's ticks are one session that ends when the day does,
    wherever the clock stands.  In append mode a bar appears once the watermark passes that end.  On a table it gives every day.
    """
    day = F.to_date(F.from_utc_timestamp("ts", tz))
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz)
    left = (F.unix_micros(end) - F.unix_micros("ts")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    watched = ticks.withWatermark("ts", watermark).withColumns({"trading_date": day, "__left": F.make_interval(secs=left.cast("decimal(18,6)"))})
    order = F.struct("ts", "tick_id")
    grouped = watched.groupBy(F.session_window("ts", F.col("__left")), "asset_id", "trading_date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n_ticks")
    )
    return grouped.select("asset_id", "trading_date", "open", "high", "low", "close", "n_ticks")


def dedupe_bars(stream: DataFrame, watermark: str = WATERMARK, at: str = "ts") -> DataFrame:
    """One row per asset and date of a stream that may repeat them."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["asset_id", "trading_date"])


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """What the stream gives of all there is now, written to a folder with its checkpoint beside it, and read again."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
