"""Folders that all executors share, for layers and streams that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this machine's in local mode, or one in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        given = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path, removed with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path
