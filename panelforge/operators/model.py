"""Walk-forward logistic regressions: features standardised by fold, two targets, probabilities of test rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import signal
from panelforge.operators.folds import fold_scalers, split
from panelforge.schemas import FEATURES

_EPOCH = date(1970, 1, 1)
TARGETS = {"p_up": "y_up_next_day", "p_large_move": "y_large_move_next"}

#: Fixed models that stand in for fitted ones: intercept, then one coefficient for each feature in order.
FIXED = {"p_up": (0.05, -4.0, -1.5, 0.5, -1.0, -0.6, -0.8), "p_large_move": (-3.4, 0.9, -0.4, 26.0, 1.2, -0.7, -4.0)}


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def fixed_predictions(rows: DataFrame, models: Mapping[str, Sequence[float]] = FIXED) -> DataFrame:
    """Adds probabilities of given linear models, to nine places, and the signal."""
    score = lambda b: sum((F.lit(c) * F.col(f) for c, f in zip(b[1:], FEATURES, strict=True)), F.lit(b[0]))
    return rows.withColumns({p: F.round(logistic(score(b)), 9) for p, b in models.items()}).withColumn("signal", signal(F.col("p_up")))


def standardise(rows: DataFrame, scalers: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows with a fold, each feature less its mean over its deviation in that fold's training rows."""
    wide = scalers.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("__s"))
    joined = rows.join(F.broadcast(wide), "fold")
    return joined.withColumns({f: (F.col(f) - F.col("__s")[f]["mean"]) / F.col("__s")[f]["std"] for f in features}).drop("__s")


def prepared(dataset: DataFrame, folds: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Every fold's rows with their role and a vector of standardised features."""
    rows = standardise(split(dataset, folds), fold_scalers(dataset, folds, features), features)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def fit_logistic(train: DataFrame, target: str, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-9) -> LogisticRegressionModel:
    """Ridge-penalised fit with a free intercept: the penalty of weight 1 against c times the summed loss."""
    labelled = train.withColumn("label", F.col(target).cast("double"))
    counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if not counts["pos"] or counts["pos"] == counts["n"]:
        raise ValueError(f"{target} has one class only in a fold's training rows")
    return LogisticRegression(regParam=1.0 / (c * counts["n"]), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(labelled)


def score(rows: DataFrame, model: LogisticRegressionModel, out: str) -> DataFrame:
    """Adds the probability of class one."""
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def fold_models(dataset: DataFrame, folds: DataFrame, features: Sequence[str] = FEATURES, targets: Mapping[str, str] = TARGETS, c: float = 1.0, tol: float = 1e-10, max_steps: int = 60) -> list[tuple]:
    """(fold, then for each target: intercept and coefficients on the features as they are) of every fold's own ridge-penalised model.

    All models take their Newton steps together: one pass over the rows gives every model's loss, gradient and Hessian at its
    present coefficients, each over its own training dates and standardised by its own scalers.  Rows are neither copied for
    expanding windows nor shuffled; a task hands on one sum a model.  A step that does not lower a model's loss is halved.
    """
    spans = {r["fold"]: r for r in folds.collect()}
    moments: dict[int, dict] = {}
    for r in fold_scalers(dataset, folds, features).collect():
        moments.setdefault(r["fold"], {})[r["feature"]] = (r["mean"], r["std"])
    days = lambda d: (d - _EPOCH).days
    plan = [(days(spans[f]["train_start"]), days(spans[f]["train_end"]), *(np.array(x) for x in zip(*(moments[f][c] for c in features), strict=True))) for f in sorted(spans)]
    labels, width = list(targets.values()), len(features) + 1
    rows = dataset.select(F.unix_date("trading_date").alias("__day"), *features, *[F.col(y).cast("double").alias(f"__{i}") for i, y in enumerate(labels)])

    def summed(at: np.ndarray) -> np.ndarray:
        """For each model: rows, positives, loss, gradient, Hessian."""

        def run(batches):
            total = np.zeros((len(plan), len(labels), 3 + width + width * width))
            for batch in batches:
                day, x = batch["__day"].to_numpy(), np.column_stack([batch[f].to_numpy() for f in features])
                y = [batch[f"__{i}"].to_numpy() for i in range(len(labels))]
                for k, (first, last, mean, spread) in enumerate(plan):
                    inside = np.flatnonzero((day >= first) & (day <= last))
                    z = np.column_stack([np.ones(len(inside)), (x[inside] - mean) / spread])
                    for i, label in enumerate(y):
                        hit, eta = label[inside], z @ at[k, i]
                        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                        sums = [len(inside), hit.sum(), (np.logaddexp(0, eta) - hit * eta).sum()]
                        total[k, i] += np.concatenate([sums, z.T @ (p - hit), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

        out = np.zeros((len(plan), len(labels), 3 + width + width * width))
        for r in rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out.ravel()[r["at"]] = r["value"]
        return out

    penalty = np.diag([0.0] + [1 / c] * (width - 1))
    base = np.zeros((len(plan), len(labels), width))
    step, least = np.zeros_like(base), np.full(base.shape[:2], np.inf)
    for _ in range(max_steps):
        sums = summed(base + step)
        for k, i in np.ndindex(*least.shape):
            n, positive, loss = sums[k, i, :3]
            if not 0 < positive < n:
                raise ValueError(f"fold {sorted(spans)[k]}: {labels[i]} has one class only among {int(n)} training rows")
            tried = base[k, i] + step[k, i]
            loss += tried @ penalty @ tried / 2
            if loss > least[k, i] + 1e-12 * abs(least[k, i]):
                step[k, i] /= 2
                continue
            base[k, i], least[k, i] = tried, loss
            slope, curve = sums[k, i, 3 : 3 + width] + penalty @ tried, sums[k, i, 3 + width :].reshape(width, width) + penalty
            step[k, i] = -np.linalg.solve(curve, slope)
        if np.abs(step).max() < tol:
            break
    found = []
    for k, fold in enumerate(sorted(spans)):
        mean, spread = plan[k][2:]
        slopes = base[k, :, 1:] / spread
        found.append((fold, *([float(b), *map(float, w)] for b, w in zip(base[k, :, 0] - slopes @ mean, slopes, strict=True))))
    return found


def walk_forward(dataset: DataFrame, folds: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Predictions of every fold's test rows: fold, asset_id, trading_date, p_up, p_large_move, signal.

    All folds' models are fitted together and score their test rows in one pass.
    """
    fits = dataset.sparkSession.createDataFrame(fold_models(dataset, folds, features), "fold int, " + ", ".join(f"__{p} array<double>" for p in TARGETS))
    linear = lambda p: sum((F.col(f"__{p}")[i + 1] * F.col(f) for i, f in enumerate(features)), F.col(f"__{p}")[0])
    test = split(dataset, folds).where("role = 'test'").join(F.broadcast(fits), "fold").withColumns({p: logistic(linear(p)) for p in TARGETS})
    return test.select("fold", "asset_id", "trading_date", *TARGETS, signal(F.col("p_up")).alias("signal"))


def model_runs(folds: DataFrame, name: str = "logreg", feature_set: str = "v1", commit: str | None = None) -> DataFrame:
    """A run's provenance for each fold."""
    return folds.select(
        F.col("fold").cast("long").alias("model_run_id"), F.lit(name).alias("model_name"), F.lit(feature_set).alias("feature_set_version"),
        "train_start", "train_end", "test_start", "test_end", F.lit(commit).cast("string").alias("git_commit"), F.current_timestamp().alias("created_at"),
    )
