"""Durable intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_owned: list[list[str]] = []  # paths given out inside each open scratch()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession):
    """Owns the intermediates: what stored() writes inside is deleted at the end. Write the result before that.

        with scratch(spark):
            cluster_novel(points, stored).write.parquet(path)
    """
    _owned.append([])
    try:
        yield
    finally:
        for name in _owned.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark) + ".parquet"
    if _owned:
        _owned[-1].append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is not needed once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path not used before in spark.checkpoint.dir; where that is unset, in a folder of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
