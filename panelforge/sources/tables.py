"""Readers and sinks: CSV with declared schemas, files put aside, rebuilt layers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.schemas import RAW_ASSETS, RAW_EVENTS, RAW_PRICES

PRICE_FIELDS = ("Open", "High", "Low", "Close", "Adj Close", "Volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(spark: SparkSession, path: str | Sequence[str], declared) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise ValueError("no input files")
    return spark.read.csv(paths, schema=declared, header=True, mode="FAILFAST")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """The asset universe; an empty field is null."""
    return _csv(spark, path, RAW_ASSETS)


def read_prices(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Daily prices from one or several files; a malformed line fails the read."""
    return _csv(spark, path, RAW_PRICES)


def read_price_files(spark: SparkSession, paths: Sequence[str], scratch: str) -> tuple[DataFrame, DataFrame]:
    """Daily prices of the files that are whole, and what each file was: file, n_rows, n_bad, has_header, accepted.

    A file is whole if every line fits the declared schema and one of them is the header.  A file that is not is left out with all its rows and
    listed; if no file is left, that is an error.  The text is read once, into ``scratch``; files are judged there.
    """
    if not paths:
        raise ValueError("no input files")
    names = [c.split()[0] for c in RAW_PRICES.split(", ")]
    text = spark.read.csv(list(paths), schema=f"{RAW_PRICES}, __bad string", header=False, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", recursiveFileLookup=True)
    lines = text.select(*names, (F.col("__bad") == ",".join(names)).alias("__header"), F.col("__bad").isNotNull().alias("__bad"), F.col("_metadata.file_path").alias("file"))
    lines.withColumn("__header", F.coalesce("__header", F.lit(False))).write.parquet(scratch)
    stored = spark.read.parquet(scratch)
    own = F.count_if(~F.col("__header"))
    seen = stored.groupBy("file").agg(own.alias("n_rows"), F.count_if(F.col("__bad") & ~F.col("__header")).alias("n_bad"), F.max("__header").alias("has_header"))
    # A listed file without an authority is written with three strokes, a row's own file with one.
    given = spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", f),) for f in text.inputFiles()], "file string")
    files = given.join(seen, "file", "left").select("file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("has_header", F.lit(False)).alias("has_header"))
    files = files.withColumn("accepted", F.col("has_header") & (F.col("n_bad") == 0))
    if files.where("accepted").isEmpty():
        raise ValueError(f"none of {len(paths)} inputs has a whole file")
    good = stored.where("not __header").join(files.where("accepted").select("file"), "file", "left_semi")
    return good.select(*names), files


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events; a file with a header only is an empty, typed table."""
    return _csv(spark, path, RAW_EVENTS)


def normalize_prices(df: DataFrame, symbol: str, source: str) -> DataFrame:
    """A vendor's frame in the shape of raw prices; every field must be there."""
    missing = [c for c in ("Date", *PRICE_FIELDS) if c not in df.columns]
    if missing:
        raise ValueError(f"price columns missing: {', '.join(missing)}")
    renamed = [F.col(f"`{c}`").cast("double").alias(c.lower().replace(" ", "_")) for c in PRICE_FIELDS]
    return df.select(F.lit(symbol).alias("symbol"), F.to_date("Date").alias("trading_date"), *renamed, F.lit(source).alias("source"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes null."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def write_layer(df: DataFrame, path: str) -> None:
    """Rebuilds a layer as files.  ``layers.Layers`` lays layers out by asset."""
    nan_to_null(df).write.mode("overwrite").parquet(path)
