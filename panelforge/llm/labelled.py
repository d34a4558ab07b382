"""Splitting labelled rows into learning and held-out parts, and drawing bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row's id falls in the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample_by_class(labels: DataFrame, key: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids of each class, by the order of their hash, with the classes' full counts.

    An id with several labels takes the largest; null ids and labels are left out.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in one.groupBy("label").count().where(F.col("label").isin(0, 1)).collect()}
    drawn = [one.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    return drawn[0].unionByName(drawn[1]), counts
