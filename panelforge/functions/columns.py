"""Column builders: blank tests, trailing measures, signals, position rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

LONG_THRESHOLD, SHORT_THRESHOLD = 0.55, 0.45
LARGE_MOVE_EXIT = 0.10
BIN_WIDTH = 0.05


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("trading_date")


def is_blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def differs(a: Column, b: Column) -> Column:
    """Inequality that takes null for a value."""
    return ~a.eqNullSafe(b)


def relative(now: Column, then: Column) -> Column:
    """now / then - 1; null where either is null or ``then`` is zero."""
    return F.try_divide(now, then) - 1


def momentum(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    return relative(c, F.lag(c, n).over(w or by_asset()))


def rolling_vol(c: Column, n: int = 20, w: WindowSpec | None = None) -> Column:
    """Sample deviation of the last n rows; early rows use what there is, two values at least."""
    return F.stddev_samp(c).over((w or by_asset()).rowsBetween(1 - n, 0))


def drawdown(c: Column, n: int = 60, w: WindowSpec | None = None) -> Column:
    return relative(c, F.max(c).over((w or by_asset()).rowsBetween(1 - n, 0)))


def signal(p_up: Column, long: float = LONG_THRESHOLD, short: float = SHORT_THRESHOLD) -> Column:
    return F.when(p_up > long, 1).when(p_up < short, -1).otherwise(0).cast("short")


def position_direction() -> Column:
    """The stored signal, not derived again."""
    return F.col("signal").cast("double")


def position_large_move(exit: float = LARGE_MOVE_EXIT) -> Column:
    return F.when(F.col("p_large_move") > exit, 0.0).otherwise(1.0)


def position_always_long() -> Column:
    return F.lit(1.0)


def position_proportional(scale: float = 1.0) -> Column:
    """For calibrated probabilities only."""
    return (F.col("p_up") - 0.5) * scale


def bin_index(p: Column, width: float = BIN_WIDTH) -> Column:
    """Index of the bin [k * width, (k + 1) * width); edges are products, as rounding would move them otherwise."""
    edges = [k * width for k in range(round(1 / width) + 1)]
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= p)) - 1


def fill_price(close: Column, side: Column, slip: float = 0.0005) -> Column:
    """Buys fill above the close, sells below it."""
    return close * (1 + F.signum(side) * slip)


def longest_lookback(names: Iterable[str]) -> int:
    """The most days that any name's ``_<n>d`` ending states."""
    found = [int(m[1]) for n in names if (m := re.search(r"_(\d+)d$", n))]
    if not found:
        raise ValueError("no name states a lookback")
    return max(found)
