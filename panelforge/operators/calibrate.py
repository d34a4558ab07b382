"""Calibration of the large-move probability on the latest slice of each fold's training rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.isotonic import isotonic_blocks, isotonic_map, map_scores

CALIBRATION_SHARE = 0.2


def calibration_slice(rows: DataFrame, share: float = CALIBRATION_SHARE) -> DataFrame:
    """Training rows of the latest ``share`` of each fold's training dates."""
    train = rows.where("role = 'train'")
    dates = train.select("fold", "trading_date").distinct()
    latest = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("trading_date"))) <= share * F.count(F.lit(1)).over(Window.partitionBy("fold"))
    first = dates.withColumn("latest", latest).where("latest").groupBy("fold").agg(F.min("trading_date").alias("__first"))
    return train.join(F.broadcast(first), "fold").where(F.col("trading_date") >= F.col("__first")).drop("__first")


def _logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(c / (1 - c))


def fit_platt(rows: DataFrame, p: str, y: str) -> tuple[list[float], list[float]]:
    """A logistic map of the score, without penalty: its intercept and slope."""
    scores = rows.select(_logit(F.col(p)).alias("score"), F.col(y).cast("double").alias("label"))
    model = LogisticRegression(regParam=0.0, tol=1e-9, maxIter=200).fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(scores))
    return [model.intercept], model.coefficients.toArray().tolist()


def apply_platt(p: Column, intercept: Column, slope: Column) -> Column:
    return 1 / (1 + F.exp(-(intercept[0] + slope[0] * _logit(p))))


def fit_isotonic(rows: DataFrame, p: str, y: str) -> tuple[list[float], list[float]]:
    """A monotone map of the score: rising scores and the values at them."""
    scores = rows.select(F.col(p).alias("features"), F.col(y).cast("double").alias("label"))
    model = IsotonicRegression(isotonic=True).fit(scores)
    return model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()


def apply_isotonic(p: Column, at: Column, values: Column) -> Column:
    """Linear between the scores, constant beyond the first and last."""
    below = F.size(F.filter(at, lambda b: b <= p))
    low, high = F.greatest(below - 1, F.lit(0)), F.least(below, F.size(at) - 1)
    a, b = F.get(at, low), F.get(at, high)
    share = F.when(b > a, F.greatest((p - a) / (b - a), F.lit(0.0))).otherwise(0.0)
    return F.get(values, low) + share * (F.get(values, high) - F.get(values, low))


def calibrate_folds(rows: DataFrame, fit: Callable, apply: Callable, p: str, y: str) -> DataFrame:
    """Test rows of every fold with ``p_calibrated``, by a map fitted on the latest slice of that fold's own training rows.

    Folds are looped over as in walk_forward; the slices are kept meanwhile.  All folds' test rows are then mapped in one pass.
    """
    latest = calibration_slice(rows).persist()
    try:
        folds = sorted(r[0] for r in latest.select("fold").distinct().collect())
        maps = [(fold, *fit(latest.where(F.col("fold") == fold), p, y)) for fold in folds]
    finally:
        latest.unpersist()
    fitted = rows.sparkSession.createDataFrame(maps, "fold int, __a array<double>, __b array<double>")
    test = rows.where("role = 'test'").join(F.broadcast(fitted), "fold")
    return test.withColumn("p_calibrated", apply(F.col(p), F.col("__a"), F.col("__b"))).drop("__a", "__b")


def calibrate_isotonic(rows: DataFrame, p: str, y: str) -> DataFrame:
    """The same by an isotonic map of each fold, for any number of scores: all folds are fitted and mapped together."""
    pieces = isotonic_map(isotonic_blocks(calibration_slice(rows), p, y, ["fold"]), ["fold"])
    return map_scores(rows.where("role = 'test'"), pieces, p, ["fold"])


def platt_maps(rows: DataFrame, p: str, y: str, by: str, tol: float = 1e-9, max_steps: int = 100) -> list[tuple]:
    """(group, intercept, slope) of every group's logistic map, without penalty; groups are a handful.

    All groups take their Newton steps together: a pass over the counted scores gives each one's loss, gradient and Hessian.  A step that does
    not lower a group's loss is halved.
    """
    counts = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(by, _logit(F.col(p)).alias("__x")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__s")).persist()
    try:
        totals = {r[0]: (r[1], r[2]) for r in counts.groupBy(by).agg(F.sum("__n"), F.sum("__s")).collect()}
        for group, (n, hits) in totals.items():
            if not 0 < hits < n:
                raise ValueError(f"{by} {group}: {y} has one class only among {n} rows")
        base, step = {g: np.zeros(2) for g in totals}, {g: np.zeros(2) for g in totals}
        least = dict.fromkeys(totals, math.inf)
        kind = counts.schema[by].dataType.simpleString()
        for _ in range(max_steps):
            tried = {g: base[g] + step[g] for g in totals}
            at = rows.sparkSession.createDataFrame([(g, *map(float, v)) for g, v in tried.items()], f"{by} {kind}, __a double, __b double")
            z = F.col("__a") + F.col("__b") * F.col("__x")
            q, n, x = 1 / (1 + F.exp(-z)), F.col("__n"), F.col("__x")
            loss = n * F.greatest(z, F.lit(0.0)) + n * F.log1p(F.exp(-F.abs(z))) - F.col("__s") * z
            sums = (loss, n * q - F.col("__s"), (n * q - F.col("__s")) * x, n * q * (1 - q), n * q * (1 - q) * x, n * q * (1 - q) * x * x)
            for r in counts.join(F.broadcast(at), by).groupBy(by).agg(*[F.sum(c) for c in sums]).collect():
                g, now = r[0], r[1]
                if now > least[g] + 1e-12 * abs(least[g]):
                    step[g] = step[g] / 2
                    continue
                base[g], least[g] = tried[g], now
                step[g] = -np.linalg.lstsq(np.array([[r[4], r[5]], [r[5], r[6]]]), np.array([r[2], r[3]]), rcond=None)[0]
            if max(np.abs(v).max() for v in step.values()) < tol:
                break
    finally:
        counts.unpersist()
    return [(g, *map(float, v)) for g, v in sorted(base.items())]


def calibrate_platt(rows: DataFrame, p: str, y: str) -> DataFrame:
    """The same by a logistic map of each fold: all folds are fitted and mapped together."""
    maps = rows.sparkSession.createDataFrame(platt_maps(calibration_slice(rows), p, y, "fold"), "fold int, __a double, __b double")
    test = rows.where("role = 'test'").join(F.broadcast(maps), "fold")
    return test.withColumn("p_calibrated", 1 / (1 + F.exp(-(F.col("__a") + F.col("__b") * _logit(F.col(p)))))).drop("__a", "__b")
