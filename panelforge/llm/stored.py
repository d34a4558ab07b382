"""Tables written to the shared folder and read again, which cuts lineage and survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from panelforge.sources.scratch import shared_dir


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {n: spark.conf.get(n) for n in values}
    for n, value in values.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def filtered_scans(spark: SparkSession):
    """Lets Spark drop rows by a Bloom filter of the join's other side before it shuffles a text column."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter"
    return _set(spark, {f"{prefix}.applicationSideScanSizeThreshold": "0", f"{prefix}.creationSideThreshold": "1GB"})


#: Rows handed to a Python worker at once: texts are long, and both sides hold a batch in memory.
TEXT_ROWS = 2000


#: A step's shuffle files go as soon as its table is written, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Written tables of one query; ``drop`` removes one that nothing reads any more, the session's end the others.  ``settings`` hold while a table is written."""

    def __init__(self, spark: SparkSession, name: str, settings: dict[str, str] | None = None):
        self.spark, self.root, self.paths, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0
        self.settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS)} | (settings or {})

    def store(self, df: DataFrame, by: str | None = None) -> DataFrame:
        return self.store_all([df], by)

    def store_all(self, frames: Iterable[DataFrame], by: str | None = None) -> DataFrame:
        """One table of several frames, each written before the next is made; ``by`` is a column whose values get folders of their own."""
        self.n += 1
        n, path = self.n, f"{self.root}/{self.n}"
        for df in frames:
            with _set(self.spark, self.settings):
                df.write.mode("append").parquet(path, partitionBy=by)
            schema = df.schema
        if n == 1:
            fs, root = self._at(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def again(self, *frames: DataFrame) -> DataFrame:
        """Stored tables of one schema, read once more together: columns of its own, for joins of a table with itself."""
        return self.spark.read.schema(frames[0].schema).parquet(*[self.paths[id(df)][0] for df in frames])

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, at = self._at(self.paths.pop(id(df))[0])
            fs.delete(at, True)
