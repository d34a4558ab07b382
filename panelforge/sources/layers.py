"""Stored layers of a panel, bucketed and sorted by asset: later windows and joins by asset read them without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from panelforge.sources.scratch import scratch_path
from panelforge.sources.tables import nan_to_null

KEY, ORDER = "asset_id", ("asset_id", "trading_date")


@contextmanager
def joined_by_asset(spark: SparkSession):
    """Plans made within may join tables on asset and date by their common buckets of assets."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Layers:
    """A set of layers with one number of buckets, under one folder that all executors share.

    A layer is an external table of the session's catalogue, which is where Spark looks up buckets; the files go with the
    session.  Rows of one asset lie in one bucket, so ``buckets`` should grow with the panel.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "layers")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"layer_{uuid.uuid4().hex}"

    def store(self, name: str, df: DataFrame, deal: bool = True, order: Sequence[str] = ORDER) -> DataFrame:
        """Writes a layer, in place of an earlier one of the name, and reads it by its buckets.

        Rows are dealt to the buckets by a shuffle.  A layer made of layers of this set needs none (``deal=False``): its
        tasks hold whole buckets as they are.
        """
        table, sort = f"{self.prefix}_{name}", [c for c in order if c in df.columns]
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        with joined_by_asset(self.spark):
            rows = nan_to_null(df)
            if deal:
                rows = rows.repartition(self.buckets, KEY)
            rows.write.mode("overwrite").option("path", f"{self.path}/{name}").bucketBy(self.buckets, KEY).sortBy(*sort).saveAsTable(table)
        return self.spark.table(table)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")


def shuffles(df: DataFrame) -> int:
    """Exchanges of rows between tasks in a plan, broadcasts left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "BroadcastExchange" not in line for line in plan.splitlines())


def report(df: DataFrame, first: Sequence[str] = ("model_run_id", "backtest_run_id", "fold", "symbol", "asset_id", "trading_date")) -> DataFrame:
    """Rows in the order in which people read them: by run, then asset, then date, as far as there are such columns.  Layers are not put in one order."""
    return df.orderBy(*[c for c in first if c in df.columns])
