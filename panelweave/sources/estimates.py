"""Saving and reading finished estimates and coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_estimates(estimates: DataFrame, path: str, period: Sequence[str] = ()) -> None:
    """One partition per statistic and variable, so a report reads only what it prints.

    With `period`, the columns that name it lead the partitions, and only those found in `estimates` are replaced: other
    periods stay as they are. Without, the whole table is replaced.
    """
    if period:
        _replace(estimates, path, [*period, "stat", "var"])
    else:
        estimates.write.mode("overwrite").partitionBy("stat", "var").parquet(path)


def write_sums(sums: DataFrame, path: str, period: Sequence[str]) -> None:
    """Land the additive sums of some periods; a period landed again is replaced whole, others stay."""
    _replace(sums, path, period)


def read_sums(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All landed sums; give the schema where a period's text could be taken for a number."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def _replace(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    # One task writes a partition's rows, so that a landing doesn't leave a file per task and partition.
    dealt = rows.repartition(*partitions)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_estimates(spark: SparkSession, path: str, stat: str | None = None, var: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if stat is not None:
        rows = rows.where(F.col("stat") == stat)
    if var is not None:
        rows = rows.where(F.col("var") == var)
    return rows


def write_coefficients(coefficients: DataFrame, path: str) -> None:
    coefficients.write.mode("overwrite").partitionBy("model").parquet(path)


def read_coefficients(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if model is None else rows.where(F.col("model") == model)


def read_regions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The region dimension with its name column called `category`."""
    return spark.read.parquet(path).withColumnRenamed(name, "category")
