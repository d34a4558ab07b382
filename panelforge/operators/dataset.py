"""The training dataset: features and labels of complete rows, the models' only input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.features import with_features
from panelforge.operators.labels import with_labels
from panelforge.schemas import FEATURES, LABELS

COLUMNS = ("asset_id", "symbol", "trading_date", *FEATURES, *LABELS)


def training_dataset(features: DataFrame, labels: DataFrame, assets: DataFrame) -> DataFrame:
    joined = features.join(labels, ["asset_id", "trading_date"]).join(assets.select("asset_id", "symbol"), "asset_id")
    return joined.select(*COLUMNS).dropna(subset=[*FEATURES, *LABELS])


def panel(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """The same rows from bars in one pass: features and labels share one shuffle by asset."""
    rows = with_labels(with_features(bars)).select("asset_id", "trading_date", *FEATURES, *LABELS).dropna()
    return rows.join(assets.select("asset_id", "symbol"), "asset_id").select(*COLUMNS)


def trading_calendar(dataset: DataFrame) -> DataFrame:
    """Distinct dates with their index from 0; a calendar has thousands of rows, not more."""
    from pyspark.sql.window import Window

    dates = dataset.select("trading_date").distinct()
    return dates.withColumn("idx", F.row_number().over(Window.orderBy("trading_date")) - 1)
