"""Events on the trading calendar: effective sessions, as-of values, distances, event studies.

As-of rules run on the calendar, which has thousands of rows, and reach the panel by a join on the date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.ordered import moments_before, over_last


def next_sessions(calendar: DataFrame) -> DataFrame:
    """day, session: for every day up to the calendar's end the first session on or after it."""
    days = calendar.agg(F.date_sub(F.min("trading_date"), 400).alias("a"), F.max("trading_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    known = days.join(calendar.select(F.col("trading_date").alias("day"), F.col("trading_date").alias("session")), "day", "left")
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return known.select("day", F.first("session", ignorenulls=True).over(ahead).alias("session"))


def effective_session(events: DataFrame, calendar: DataFrame, tz: str = "America/New_York", close: str = "16:00") -> DataFrame:
    """Adds ``session``: the first one whose close reflects the event; null after the calendar's end.

    A date that the source states is used as it is; otherwise the release's market date, the next day's after the close.
    """
    local = F.from_utc_timestamp("event_ts", tz)
    late = F.date_format(local, "HH:mm") >= close
    day = F.coalesce("event_date", F.date_add(F.to_date(local), F.when(late, 1).otherwise(0)))
    return events.withColumn("day", day).join(F.broadcast(next_sessions(calendar)), "day", "left").drop("day")


def last_event_asof(calendar: DataFrame, events: DataFrame, value: str = "surprise", date: str = "session") -> DataFrame:
    """trading_date, event_type, event_date, value: each type's latest event on or before the session."""
    on_day = events.where(F.col(date).isNotNull()).groupBy("event_type", F.col(date).alias("trading_date"))
    newest = on_day.agg(F.max_by(F.struct(F.col(date).alias("event_date"), F.col(value).alias("value")), F.struct("event_ts", "event_id")).alias("e"))
    grid = calendar.select("trading_date").crossJoin(F.broadcast(events.select("event_type").distinct()))
    w = Window.partitionBy("event_type").orderBy("trading_date")
    filled = grid.join(newest, ["event_type", "trading_date"], "left").withColumn("e", F.last("e", ignorenulls=True).over(w))
    return filled.select("trading_date", "event_type", F.col("e.event_date").alias("event_date"), F.col("e.value").alias(value))


def standardised_surprise(events: DataFrame, n: int | None = None) -> DataFrame:
    """Surprise over the deviation of the type's earlier surprises, all or the last n of them.

    A type's events are ordered in slices, and what a slice needs of those before it is carried over.
    """
    at = (F.to_date("event_ts"), ("event_ts", "event_id"))
    if n is None:
        past = moments_before(events, "event_type", *at, "surprise")
        spread = F.when(F.col("__n") > 1, F.sqrt(F.col("__m2") / (F.col("__n") - 1)))
        return past.withColumn("surprise_std", F.try_divide("surprise", spread)).drop("__n", "__m2")
    return over_last(events, "event_type", *at, n, {"surprise_std": lambda w: F.try_divide("surprise", F.stddev_samp("surprise").over(w))})


def event_distance(calendar: DataFrame, events: DataFrame, cap: int = 30, date: str = "session") -> DataFrame:
    """trading_date, event_type, days_since, days_until, is_event_day, counted in sessions and capped."""
    hit = events.where(F.col(date).isNotNull()).select("event_type", F.col(date).alias("trading_date"), F.lit(True).alias("is_event_day")).distinct()
    grid = calendar.select("trading_date", "idx").crossJoin(F.broadcast(events.select("event_type").distinct()))
    marked = grid.join(hit, ["event_type", "trading_date"], "left").withColumn("at", F.when(F.col("is_event_day"), F.col("idx")))
    w = Window.partitionBy("event_type").orderBy("idx")
    before = F.last("at", ignorenulls=True).over(w)
    after = F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return marked.select(
        "trading_date",
        "event_type",
        F.least(F.col("idx") - before, F.lit(cap)).alias("days_since"),
        F.least(after - F.col("idx"), F.lit(cap)).alias("days_until"),
        F.coalesce("is_event_day", F.lit(False)).alias("is_event_day"),
    )


def event_features(dataset: DataFrame, distances: DataFrame) -> DataFrame:
    """Each type's distances, its indicator and the indicator's product with momentum, joined to the panel by date."""
    flags = distances.select("trading_date", "event_type", "days_since", "days_until", "is_event_day")
    return dataset.join(flags, "trading_date", "left").withColumn("mom_20d_event", F.when(F.col("is_event_day"), F.col("mom_20d")).otherwise(0.0))


def event_car(returns: DataFrame, events: DataFrame, est: tuple[int, int] = (-60, -6), win: tuple[int, int] = (-5, 5), date: str = "session") -> DataFrame:
    """asset_id, trading_date, event_type, car: abnormal return summed over the window around each type's event days an asset traded on.

    The market is the day's mean return.  Its model is fitted on the asset's own rows ``est`` before the event; incomplete
    windows give null.
    """
    market = returns.where(F.col("ret_1d").isNotNull()).groupBy("trading_date").agg(F.avg("ret_1d").alias("mkt"))
    days = events.where(F.col(date).isNotNull()).select("event_type", F.col(date).alias("trading_date")).distinct()
    rows = returns.where(F.col("ret_1d").isNotNull()).join(F.broadcast(market), "trading_date")
    w = Window.partitionBy("asset_id").orderBy("trading_date")
    before, around = w.rowsBetween(*est), w.rowsBetween(*win)
    fitted = rows.withColumns(
        {
            "n_est": F.count("ret_1d").over(before),
            "beta": F.regr_slope("ret_1d", "mkt").over(before),
            "alpha": F.regr_intercept("ret_1d", "mkt").over(before),
            "n_win": F.count("ret_1d").over(around),
            "sum_ret": F.sum("ret_1d").over(around),
            "sum_mkt": F.sum("mkt").over(around),
        }
    )
    full = (F.col("n_est") == est[1] - est[0] + 1) & (F.col("n_win") == win[1] - win[0] + 1)
    car = F.when(full, F.col("sum_ret") - F.col("n_win") * F.col("alpha") - F.col("beta") * F.col("sum_mkt"))
    return fitted.join(days, "trading_date").select("asset_id", "trading_date", "event_type", car.alias("car"))
