"""Panels derived from the given tables: bars from order lines, events from orders, ticks from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.ordered import over_last
from panelforge.sources.tables import table


def raw_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset for each supplier, with gaps in asset_type and currency."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left")
    return joined.select(
        F.col("s_name").alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 != 0, "equity").alias("asset_type"),
        F.when(F.col("s_suppkey") % 3 != 0, "EUR").alias("currency"),
        F.col("n_name").alias("exchange"),
        F.lit("supplier").alias("source"),
    )


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: order lines are ticks, ordered within a day by their keys."""
    tick = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = 1000 + F.col("l_extendedprice") / 1000
    bars = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("trading_date"))
        .agg(
            F.min_by(price, tick).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, tick).alias("close"),
            F.max_by(price * (1 - F.col("l_discount") / 10), tick).alias("adj_close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol"))
    return bars.join(names, "l_suppkey").select("symbol", "trading_date", "open", "high", "low", "close", "adj_close", "volume", F.lit("lineitem").alias("source"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each order, of as many types as there are priorities."""
    key = F.col("o_orderkey")
    hours = F.make_dt_interval(hours=key % 24, mins=key % 60)
    forecast = F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, F.lit(0.0)).otherwise(F.col("o_totalprice") * (1 + ((key % 7) - 3) / F.lit(100.0)))
    events = table(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        F.col("o_orderpriority").alias("event_type"),
        (F.col("o_orderdate").cast("timestamp") + hours).alias("event_ts"),
        F.when(key % 5 == 0, F.date_add(F.to_date("o_orderdate"), 1)).alias("event_date"),
        F.col("o_totalprice").alias("actual"),
        forecast.alias("forecast"),
        F.concat(F.lit("  Order "), key.cast("string"), F.lit(" ")).alias("raw_text"),
    )
    # The value before: over the one row before, as a window of slices.
    return over_last(events, "event_type", F.to_date("event_ts"), ("event_ts", "event_id"), 1, {"previous": lambda w: F.first("actual").over(w)})


def _ticks(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("asset_id"), F.col("ts").cast("timestamp").alias("ts"), (100 + F.col("value") / 100).alias("price"), F.col("event_id").alias("tick_id"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, ts, price and tick_id of the event stream."""
    return _ticks(table(spark, sf_dir, "events"))


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    declared = table(spark, sf_dir, "events").schema
    found = spark.readStream.schema(declared).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return _ticks(found.parquet(f"{sf_dir}/event[s].parquet"))
