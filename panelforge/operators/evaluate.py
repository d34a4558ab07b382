"""Evaluation of probabilities: exact AUC, confusion, calibration, naive baseline, spreads over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.columns import BIN_WIDTH, LONG_THRESHOLD, bin_index

#: Slices of the score's range that are ordered apart in a large group.
SLICES = 1024


def select_runs(preds: DataFrame, ids: Sequence[int] | None = None, run: str = "model_run_id") -> DataFrame:
    """Predictions of the given runs, or of all."""
    return preds if ids is None else preds.where(F.col(run).isin(list(ids)))


def scored_predictions(preds: DataFrame, labels: DataFrame, assets: DataFrame) -> DataFrame:
    """Predictions with their realised return; a missing one drops the row, it is never filled."""
    known = labels.where(F.col("ret_fwd_1d").isNotNull())
    return preds.join(known, ["asset_id", "trading_date"]).join(assets.select("asset_id", "symbol"), "asset_id")


def evaluation_rows(preds: DataFrame, labels: DataFrame, assets: DataFrame) -> DataFrame:
    return scored_predictions(preds, labels, assets).dropna(subset=["y_up_next_day", "y_large_move_next"])


def score_counts(rows: DataFrame, y: str, p: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """level (its place in ``levels``), their columns, score, pos, neg: labels counted by score at several levels, in one shuffle of the rows."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    label = F.col(y).cast("int")
    known = rows.where(label.isNotNull() & F.col(p).isNotNull()).select(*columns, F.col(p).alias("__p"), label.alias("__y"))
    sums = (F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg"))
    if len(levels) == 1:
        return known.groupBy(*columns, "__p").agg(*sums).withColumn("level", F.lit(0))
    # A bit of the grouping's number is set for a column that the level lacks; a null in a level's own column is a group.
    number = lambda level: sum((c not in level) << (len(columns) - i) for i, c in enumerate(columns))
    which = F.element_at(F.create_map(*[F.lit(x) for i, level in enumerate(levels) for x in (number(level), i)]), F.grouping_id().cast("int"))
    return known.groupingSets([[*level, "__p"] for level in levels], *columns, "__p").agg(*sums, which.alias("level"))


def auc_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tie-aware AUC of each group from its counted scores: null where only one class occurs.

    A group's scores, in [0, 1], are ordered in slices; a slice's totals carry the count of lower negatives over to the next, so no
    task orders a group.
    """
    keys = list(by)
    sliced = counts.withColumn("__slice", F.floor(F.col("__p") * SLICES))
    lower = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sliced.withColumn("__within", lower(Window.partitionBy(*keys, "__slice").orderBy("__p")))
    own = F.sum(F.col("pos") * (F.col("__within") + F.col("neg") / 2)).alias("__own")
    slices = within.groupBy(*keys, "__slice").agg(own, F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    carried = slices.withColumn("__below", lower(Window.partitionBy(*keys).orderBy("__slice")))
    out = carried.groupBy(*keys).agg(F.sum(F.col("__own") + F.col("pos") * F.col("__below")).alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*keys, F.try_divide("won", F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def auc(rows: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Tie-aware AUC for each group: null where only one class occurs.  Scores are counted first."""
    return auc_of_counts(score_counts(rows, y, p, [by]), by)


def auc_levels(rows: DataFrame, y: str, p: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """level, the levels' columns (null where a level lacks one), auc, n_pos, n_neg: several tables of AUC from one count of scores."""
    return auc_of_counts(score_counts(rows, y, p, levels), ["level", *dict.fromkeys(c for level in levels for c in level)])


def confusion(rows: DataFrame, by: Sequence[str], threshold: float = LONG_THRESHOLD) -> DataFrame:
    up, said = F.col("y_up_next_day"), F.col("p_up") > threshold
    counts = {"tp": said & up, "fp": said & ~up, "fn": ~said & up, "tn": ~said & ~up}
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))


def calibration_fixed(rows: DataFrame, p: str, y: str, by: Sequence[str] = (), width: float = BIN_WIDTH) -> DataFrame:
    """Count, mean prediction and realised rate of each bin that is not empty; a prediction of exactly one is past the last bin."""
    binned = rows.withColumn("bin", bin_index(F.col(p), width)).where(F.col("bin").between(0, round(1 / width) - 1))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("int")).alias("realized"))


def quantiles(rows: DataFrame, p: str, bins: int) -> DataFrame:
    """i and edge, the interpolated i-th of ``bins`` quantiles of a score in [0, 1], exact.

    Scores are counted, and the counts ordered in slices, as for the AUC: no task holds all of them.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__slice", F.floor(F.col("__p") * SLICES))
    totals = counts.groupBy("__slice").agg(F.sum("__n").alias("__all"))
    lower = F.coalesce(F.sum("__all").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__slice", lower.alias("__below"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__slice").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.col("__below") + within
    ranked = counts.join(F.broadcast(offsets), "__slice").select("__p", first.alias("__first"), (first + F.col("__n")).alias("__end"))
    places = rows.sparkSession.range(bins + 1).join(F.broadcast(totals.agg(F.sum("__all").alias("__total"))))
    places = places.select(F.col("id").alias("i"), (F.col("id") / bins * (F.col("__total") - 1)).alias("__at"))
    wanted = places.select("i", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__place"))
    met = ranked.join(F.broadcast(wanted), (F.col("__place") >= F.col("__first")) & (F.col("__place") < F.col("__end")))
    low, share = F.min_by("__p", "__place"), F.first("__at") - F.min("__place")
    return met.groupBy("i").agg(((1 - share) * low + share * F.max_by("__p", "__place")).alias("edge"))


def calibration_quantile(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """The same over bins of equal counts, pooled: interpolated quantile edges, repeated ones merged, closed on the right."""
    edges = quantiles(rows, p, bins).agg(F.array_distinct(F.array_sort(F.collect_list("edge"))).alias("edges"))
    above = F.size(F.filter("edges", lambda e: e < F.col(p)))
    binned = rows.join(F.broadcast(edges)).withColumn("bin", F.greatest(above - 1, F.lit(0)))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("int")).alias("realized"))


def naive_baseline(rows: DataFrame, threshold: float = LONG_THRESHOLD) -> DataFrame:
    """Per fold: the training majority's accuracy on test rows, the model's, and the base rate.  ``rows`` have fold and role."""
    up = F.col("y_up_next_day").cast("int")
    majority = rows.where("role = 'train'").groupBy("fold").agg(F.bround(F.avg(up)).cast("int").alias("majority"))
    right = lambda c: F.avg((c == up).cast("int"))
    test = rows.where("role = 'test'").join(F.broadcast(majority), "fold")
    model = (F.col("p_up") > threshold).cast("int")
    return test.groupBy("fold", "majority").agg(right(F.col("majority")).alias("naive_accuracy"), right(model).alias("model_accuracy"), F.avg(up).alias("base_rate"))


def fold_distribution(aucs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return aucs.groupBy(*by).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.min("auc").alias("min"), F.max("auc").alias("max"), F.count("auc").alias("n"))


def symbol_distribution(auc_up: DataFrame, auc_large: DataFrame) -> DataFrame:
    """Per symbol of either table: mean and population deviation over folds for both targets, and the larger count of folds."""
    side = lambda df, n: df.where("auc is not null").groupBy("symbol").agg(F.avg("auc").alias(f"{n}_mean"), F.stddev_pop("auc").alias(f"{n}_std"), F.count(F.lit(1)).alias(f"{n}_n"))
    both = side(auc_up, "up").join(side(auc_large, "large"), "symbol", "full")
    return both.select("symbol", "up_mean", "up_std", "large_mean", "large_std", F.greatest("up_n", "large_n").alias("folds"))


def brier(rows: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y).cast("int"), F.lit(2))).alias("brier"))


def event_day_slice(rows: DataFrame, flags: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean prediction, realised rate and Brier score on event days and on others; with ``by``, flags have every date of each group."""
    marked = rows.join(flags.select("trading_date", *by, "is_event_day"), "trading_date", "left").withColumn("is_event_day", F.coalesce("is_event_day", F.lit(False)))
    hit = F.col(y).cast("int")
    return marked.groupBy(*by, "is_event_day").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(hit).alias("realized"), F.avg(F.pow(F.col(p) - hit, F.lit(2))).alias("brier"))


def paired_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """auc of b less that of a, by fold."""
    return a.select("fold", F.col("auc").alias("a")).join(b.select("fold", F.col("auc").alias("b")), "fold").select("fold", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def bonferroni(alpha: float, m: int) -> float:
    """The level of each of m comparisons."""
    return alpha / m


