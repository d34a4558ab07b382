"""Walk-forward folds over the trading calendar, with an embargo between training and test dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_FOLDS, INITIAL, EMBARGO = 5, 0.5, 60


def fold_bounds(n: int, n_folds: int = N_FOLDS, initial: float = INITIAL, embargo: int = EMBARGO, train_window: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """fold, then places in a calendar of ``n`` dates: first and last of training, first and last of test.

    Training ends at evenly spaced cuts; a test reaches to the next cut, the last one to the calendar's end.
    """
    first_cut = int(n * initial)
    width = (n - first_cut) // n_folds
    if width <= embargo:
        raise ValueError(f"{n} dates make blocks of {width}, which embargo_days={embargo} uses up")
    cuts = [first_cut + k * width for k in range(n_folds)]
    held = n if train_window is None else train_window
    rows = zip(range(1, n_folds + 1), (max(c + 1 - held, 0) for c in cuts), cuts, (c + 1 + embargo for c in cuts), [*cuts[1:], n - 1], strict=True)
    return [r for r in rows if r[3] <= r[4]]


def generate_folds(dataset: DataFrame, n_folds: int = N_FOLDS, initial: float = INITIAL, embargo: int = EMBARGO, train_window: int | None = None) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end; training windows expand unless ``train_window`` fixes their length.

    The dates of ``dataset`` are read when this is called: pass a stored one, of which only that column is read.
    """
    # A calendar has a row for each day at most.
    dates = sorted(r[0] for r in dataset.select("trading_date").distinct().collect())
    rows = [(fold, *(dates[i] for i in places)) for fold, *places in fold_bounds(len(dates), n_folds, initial, embargo, train_window)]
    return dataset.sparkSession.createDataFrame(rows, "fold int, train_start date, train_end date, test_start date, test_end date")


def split(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row once for each fold and role it has; a handful of folds is broadcast into a range join."""
    day = F.col("trading_date")
    train = day.between(F.col("train_start"), F.col("train_end"))
    test = day.between(F.col("test_start"), F.col("test_end"))
    joined = rows.join(F.broadcast(folds), train | test)
    return joined.withColumn("role", F.when(train, "train").otherwise("test")).drop("train_start", "train_end", "test_start", "test_end")


def embargo_reach(dataset: DataFrame, folds: DataFrame, lookback: int = 60) -> DataFrame:
    """Test rows, and those whose window of ``lookback`` rows begins at or before the end of training: gaps in a series stretch it."""
    back = F.lag("trading_date", lookback - 1).over(Window.partitionBy("asset_id").orderBy("trading_date"))
    rows = dataset.select("asset_id", "trading_date", back.alias("reach"))
    test = rows.join(F.broadcast(folds), F.col("trading_date").between(F.col("test_start"), F.col("test_end")))
    return test.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("reach") <= F.col("train_end")).alias("n_reaching"))


def fold_scalers(dataset: DataFrame, folds: DataFrame, features) -> DataFrame:
    """fold, feature, mean and population deviation over the fold's training rows, for all folds in one pass.

    Moments are summed by date, so the folds' ranges are joined to the calendar and not to the rows.
    """
    sums = [e for c in features for e in (F.sum(c).alias(f"{c}__1"), F.sum(F.col(c) * F.col(c)).alias(f"{c}__2"))]
    by_date = dataset.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n"), *sums)
    inside = F.col("trading_date").between(F.col("train_start"), F.col("train_end"))
    whole = by_date.join(F.broadcast(folds), inside).groupBy("fold").agg(F.sum("n").alias("n"), *[F.sum(f"{c}__{k}").alias(f"{c}__{k}") for c in features for k in (1, 2)])

    def moments(c: str):
        mean = F.col(f"{c}__1") / F.col("n")
        spread = F.sqrt(F.greatest(F.col(f"{c}__2") / F.col("n") - mean * mean, F.lit(0.0)))
        return F.struct(F.lit(c).alias("feature"), mean.alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("std"))

    return whole.select("fold", F.inline(F.array(*map(moments, features))))
