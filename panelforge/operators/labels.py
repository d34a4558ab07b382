"""Forward labels: the only file that looks ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import by_asset, relative
from panelforge.schemas import LABELS

LARGE_MOVE = 2.0


def with_forward(bars: DataFrame) -> DataFrame:
    """Adds the next session's return."""
    return bars.withColumn("ret_fwd_1d", relative(F.lead("adj_close").over(by_asset()), F.col("adj_close")))


def _labelled(rows: DataFrame, k: float) -> DataFrame:
    size = F.abs("ret_fwd_1d")
    return rows.withColumns({"abs_ret_fwd_1d": size, "y_up_next_day": F.col("ret_fwd_1d") > 0, "y_large_move_next": size > k * F.col("vol_20d")})


def labels_daily(bars: DataFrame, features: DataFrame, k: float = LARGE_MOVE) -> DataFrame:
    """Return, size and the two binary labels of the session after each row; null where it is unknown."""
    keys = ["asset_id", "trading_date"]
    joined = with_forward(bars.select(*keys, "adj_close")).join(features.select(*keys, "vol_20d"), keys, "left")
    return _labelled(joined, k).select(*keys, *LABELS)


def with_labels(rows: DataFrame, k: float = LARGE_MOVE) -> DataFrame:
    """The same labels where bars and features are in one table already: no join and no second shuffle."""
    return _labelled(with_forward(rows), k)
