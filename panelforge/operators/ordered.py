"""Windows of a bounded number of earlier rows over long groups, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a group that are ordered together.
SLICE = 50_000


def numbered(rows: DataFrame, by: str, day: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in its group from 0: within its day, and the counts of the days before.

    ``day`` must not fall as ``order`` rises; the table of days is as small as a calendar.
    """
    dated = rows.withColumn("__day", day)
    counts = dated.groupBy(by, "__day").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(F.col(by).alias("__by"), F.col("__day").alias("__at"), F.coalesce(before, F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy(by, "__day").orderBy(*order)) - 1
    placed = dated.withColumn("__within", within).join(ahead, F.col(by).eqNullSafe(F.col("__by")) & F.col("__day").eqNullSafe(F.col("__at")))
    return placed.withColumn(name, F.col("__ahead") + F.col("__within")).drop("__day", "__within", "__by", "__at", "__ahead")


def over_last(rows: DataFrame, by: str, day: Column, order: Sequence[str], n: int, columns: Mapping[str, Callable[[WindowSpec], Column]], size: int | None = None) -> DataFrame:
    """Adds columns over each row's last n rows of its group (not itself).

    A group is cut into slices of ``size`` rows, n or more, and each slice is given the last n rows before it.
    """
    size = max(n, SLICE if size is None else size)
    placed = numbered(rows, by, day, order, "__place").withColumn("__slice", F.floor(F.col("__place") / size))
    behind = F.when(F.col("__place") % size >= size - n, F.array(F.col("__slice"), F.col("__slice") + 1)).otherwise(F.array("__slice"))
    dealt = placed.withColumn("__into", F.explode(behind))
    w = Window.partitionBy(by, "__into").orderBy("__place").rowsBetween(-n, -1)
    whole = dealt.withColumns({name: make(w) for name, make in columns.items()})
    return whole.where(F.col("__into") == F.col("__slice")).drop("__place", "__slice", "__into")


def moments_before(rows: DataFrame, by: str, day: Column, order: Sequence[str], value: str, size: int | None = None) -> DataFrame:
    """Adds __n and __m2: of the known values in all earlier rows of the group, how many, and the squared deviations from their mean.

    A group is cut into slices of ``size`` rows.  Counts, sums and squares are taken about the group's mean, so that little is
    lost to rounding, and can be added: a slice starts from the totals of those before it, and no task orders a group.
    """
    size = SLICE if size is None else size
    centres = rows.groupBy(F.col(by).alias("__by")).agg(F.avg(value).alias("__centre"))
    placed = numbered(rows, by, day, order, "__place").withColumn("__slice", F.floor(F.col("__place") / size))
    off = placed.join(centres, F.col(by).eqNullSafe(F.col("__by"))).drop("__by").withColumn("__d", F.col(value) - F.col("__centre"))
    parts = {"n": F.col("__d").isNotNull().cast("long"), "s": F.coalesce("__d", F.lit(0.0)), "q": F.coalesce(F.col("__d") * F.col("__d"), F.lit(0.0))}
    totals = off.groupBy(F.col(by).alias("__by"), F.col("__slice").alias("__at")).agg(*[F.sum(c).alias(f"__all_{k}") for k, c in parts.items()])
    ahead = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__by", "__at", *[F.coalesce(F.sum(f"__all_{k}").over(ahead), F.lit(0)).alias(f"__before_{k}") for k in parts])
    within = Window.partitionBy(by, "__slice").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    summed = off.withColumns({f"__in_{k}": F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in parts.items()})
    joined = summed.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__slice") == F.col("__at")))
    n, s, q = (F.col(f"__in_{k}") + F.col(f"__before_{k}") for k in parts)
    return joined.select(*rows.columns, n.alias("__n"), F.greatest(q - s * F.try_divide(s, n), F.lit(0.0)).alias("__m2"))
