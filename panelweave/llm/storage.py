"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelweave.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; Spark's file system removes it when the application ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)
    return path


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a written table: it cuts lineage, and a lost executor costs a re-read of files."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove(frame: DataFrame) -> None:
    """Delete the files of a table made by `written` once its readers are done."""
    for file in frame.inputFiles()[:1]:
        target, system = _hadoop(frame.sparkSession, file.rpartition("/")[0])
        system.delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
