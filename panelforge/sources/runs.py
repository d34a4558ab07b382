"""A sink of model runs: each append adds runs, their predictions and their provenance together, or nothing.

An append writes its files to a folder of its own, with runs numbered from 0 within it, and is committed by the appearance of the next file in the
log, which names the folder, the append's key and its first run id.  The log's file is written aside and renamed to a name that
must not exist, so of two appends that race for a place one takes the next.  Readers take the folders that the log
names: an append that failed, or has not ended, is not there for them.  Ids follow from the log, so they continue whatever
was committed before and no two runs share one.  An append whose key is in the log already changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.sources.tables import nan_to_null

#: Runs in one append; they are numbered in one task and broadcast to their predictions.
MOST_RUNS = 10_000
_LOG = "version long, key string, folder string, first_id long, n long"


class RunSink:
    """Runs under ``path``.  ``order`` identifies a run within an append, in runs and predictions alike."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ("fold",), name: str = "model_run_id"):
        self.spark, self.path, self.order, self.name = spark, path.rstrip("/"), list(order), name
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._kept = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.path}/log"))

    def committed(self) -> list:
        """The log's entries, in order."""
        files = [str(s.getPath()) for s in self._fs.listStatus(self._path(f"{self.path}/log")) if s.getPath().getName().endswith(".json")]
        return self.spark.read.schema(_LOG).json(files).orderBy("version").collect() if files else []

    def stage(self, runs: DataFrame, predictions: DataFrame) -> tuple[str, int]:
        """Writes an append's files, which nobody reads before ``commit``: its folder, and how many runs it has."""
        folder = uuid.uuid4().hex
        n = runs.count()
        if n > MOST_RUNS or n != runs.select(*self.order).distinct().count():
            raise ValueError(f"an append takes {MOST_RUNS} runs at most, each once by {', '.join(self.order)}; got {n}")
        numbered = runs.withColumn("ordinal", (F.row_number().over(Window.orderBy(*self.order)) - 1).cast("long"))
        nan_to_null(numbered).write.parquet(f"{self.path}/data/folder={folder}/runs")
        ids = F.broadcast(numbered.select(*self.order, "ordinal"))
        nan_to_null(predictions.join(ids, self.order)).write.parquet(f"{self.path}/data/folder={folder}/predictions")
        return folder, n

    def commit(self, key: str, folder: str, n: int) -> list[int]:
        """Makes a staged append readable, unless its key is; the ids of the key's runs."""
        while True:
            log = self.committed()
            there = next((e for e in log if e["key"] == key), None)
            if there is not None:
                return [there["first_id"] + i for i in range(there["n"])]
            entry = {"version": len(log), "key": key, "folder": folder, "first_id": max((e["first_id"] + e["n"] for e in log), default=1), "n": n}
            aside = self._path(f"{self.path}/log/.{uuid.uuid4().hex}")
            out = self._fs.create(aside, True)
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            try:
                self._context.rename(aside, self._path(f"{self.path}/log/{len(log):012d}.json"), self._kept)
            except Exception as e:
                self._fs.delete(aside, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                continue  # another append took the place
            return [entry["first_id"] + i for i in range(n)]

    def append(self, key: str, runs: DataFrame, predictions: DataFrame) -> list[int]:
        """Adds runs and their predictions under new ids; a repeated key gives the ids it has."""
        there = next((e for e in self.committed() if e["key"] == key), None)
        return self.commit(key, *((there["folder"], there["n"]) if there else self.stage(runs, predictions)))

    def _read(self, kind: str) -> DataFrame:
        log = self.committed()
        if not log:
            raise ValueError(f"no run has been appended to {self.path}")
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/folder={e['folder']}/{kind}" for e in log])
        firsts = self.spark.createDataFrame([(e["folder"], e["first_id"]) for e in log], "folder string, first_id long")
        return rows.join(F.broadcast(firsts), "folder").withColumn(self.name, F.col("first_id") + F.col("ordinal")).drop("folder", "first_id", "ordinal")

    def runs(self) -> DataFrame:
        """Every committed run with its id and provenance."""
        return self._read("runs")

    def predictions(self) -> DataFrame:
        """The predictions of every committed run, under its id."""
        return self._read("predictions")
