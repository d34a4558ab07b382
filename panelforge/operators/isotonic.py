"""Isotonic calibration of any number of scores: pooled in slices, applied by a join on buckets of the score.

Scores are counted first.  A group's counted scores are cut, in order, into slices of about ``SLICE`` scores; adjacent violators are
pooled within each slice, then the slices' remaining blocks are merged in order, ``FAN_IN`` neighbours at a time, until one is left.
Pooling blocks gives what pooling their scores gives, so the order of merging does not matter.  Blocks have strictly rising means,
quotients of counts: of N rows there are at most about N ** (2/3), and of noisy labels about N ** (1/3); only blocks meet in the
last merge.  The map is never broadcast by force nor held in a row: its pieces are joined to scores by group and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE, FAN_IN, BUCKETS = 100_000, 16, 8192


def bucket(c: Column) -> Column:
    """The bucket of a score in [0, 1]; a score outside counts to the nearest one, null to none."""
    return F.when(c.isNotNull(), F.least(F.greatest(F.floor(c * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))).cast("int")


def pool(low: np.ndarray, high: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[tuple]:
    """Blocks (low, high, n, s) in rising order of their scores, neighbours pooled until the means s / n rise."""
    stack: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), s.tolist(), strict=True):
        a, b, m, t = block
        while stack and stack[-1][3] * m >= t * stack[-1][2]:
            a, _, k, u = stack.pop()
            m, t = m + k, t + u
        stack.append([a, b, m, t])
    return stack


def isotonic_blocks(rows: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """``by``, low, high, n, s: the blocks of each group's isotonic fit, whose value is s / n."""
    keys = list(by)
    known = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    counts = known.groupBy(*keys, F.col(p).alias("low")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    counts = counts.withColumns({"high": F.col("low"), "__bucket": bucket(F.col("low"))})
    sizes = counts.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = sizes.select(*keys, "__bucket", F.floor(before / SLICE).cast("int").alias("__slice"))
    blocks = counts.join(slices, [*keys, "__bucket"]).select(*keys, "__slice", "low", "high", "n", "s")
    schema = blocks.schema

    def pooled(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        out = pd.DataFrame(pool(*(frame[c].to_numpy() for c in ("low", "high", "n", "s"))), columns=["low", "high", "n", "s"])
        for c in (*keys, "__slice"):
            out[c] = frame[c].iloc[0]
        return out[schema.names]

    last = slices.agg(F.max("__slice")).first()[0] or 0
    blocks = blocks.groupBy(*keys, "__slice").applyInPandas(pooled, schema)
    while last:
        last //= FAN_IN
        blocks = blocks.withColumn("__slice", F.floor(F.col("__slice") / FAN_IN).cast("int")).groupBy(*keys, "__slice").applyInPandas(pooled, schema)
    return blocks.drop("__slice")


def isotonic_map(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, bucket, x0, v0, x1, v1: for each bucket the pieces that cover scores in it; from x0 up to x1, open ends null."""
    keys = list(by)
    value = F.col("s") / F.col("n")
    points = blocks.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("x0"), value.alias("v0"))
    order = Window.partitionBy(*keys).orderBy("x0")
    pieces = points.select(*keys, "x0", "v0", F.lead("x0").over(order).alias("x1"), F.lead("v0").over(order).alias("v1"), (F.row_number().over(order) == 1).alias("first"))
    nothing = F.lit(None).cast("double")
    piece = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("x0", "v0", "x1", "v1"), strict=True)])
    own = piece(F.col("x0"), F.col("v0"), F.col("x1"), F.col("v1"))
    ahead = piece(nothing, F.col("v0"), F.col("x0"), F.col("v0"))
    whole = pieces.select(*keys, F.inline(F.when(F.col("first"), F.array(ahead, own)).otherwise(F.array(own))))
    ends = F.coalesce(bucket(F.col("x0")), F.lit(0)), F.coalesce(bucket(F.col("x1")), F.lit(BUCKETS - 1))
    return whole.withColumn("bucket", F.explode(F.sequence(*ends)))


def map_scores(rows: DataFrame, pieces: DataFrame, p: str, by: Sequence[str], out: str = "p_calibrated") -> DataFrame:
    """Adds the calibrated score: linear between the fit's scores, constant beyond the first and last; null without a map."""
    keys = list(by)
    score = F.col(f"__r.{p}")
    same = [F.col(f"__r.{k}").eqNullSafe(F.col(f"__m.{k}")) for k in keys]
    inside = (F.coalesce(score >= F.col("__m.x0"), F.lit(True))) & F.coalesce(score < F.col("__m.x1"), F.lit(True))
    on = F.col("__r.__bucket") == F.col("__m.bucket")
    for c in (*same, inside):
        on = on & c
    joined = rows.withColumn("__bucket", bucket(F.col(p))).alias("__r").join(pieces.alias("__m"), on, "left")
    share = F.coalesce((score - F.col("__m.x0")) / (F.col("__m.x1") - F.col("__m.x0")), F.lit(0.0))
    value = F.col("__m.v0") + share * (F.coalesce(F.col("__m.v1"), F.col("__m.v0")) - F.col("__m.v0"))
    return joined.select(*[F.col(f"__r.`{c}`") for c in rows.columns], value.alias(out))
