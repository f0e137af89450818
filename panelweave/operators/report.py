"""Report tables from estimates and coefficients. All inputs here are small, finished tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.scalars import decimal_text, number_text, percent_text
from panelweave.operators.estimate import MEAN, SHARE, TOTAL
from panelweave.operators.skew import lookup_join

# Significance cut-offs of the stars.
STAR_CUTOFFS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


@dataclass(frozen=True)
class Block:
    """One titled section of a report: the categories of one estimated variable."""

    title: str
    var: str
    stat: str = SHARE
    percent: bool = True


def totals_report(estimates: DataFrame, subpops: Mapping[str, str], period: str = "year") -> DataFrame:
    """Population totals, one row per category and period, one column per sub-population."""
    totals = estimates.where(F.col("stat") == TOTAL).withColumnRenamed("var", "category")
    wide = totals.groupBy("category", period).pivot("subpop", list(subpops)).agg(F.first("value"))
    return wide.withColumnsRenamed(dict(subpops))


def blocks_report(
    estimates: DataFrame,
    blocks: Sequence[Block],
    subpops: Mapping[str, str],
    period: Column,
    positive_only: bool = False,
) -> DataFrame:
    """Titled sections one below the other, values as text.

    Every section starts with a title row without values. A category known to only one
    sub-population stays, with NULL for the others. Rows sort by (block, ord).
    """
    rows = estimates.where(period & F.col("subpop").isin(*subpops))
    if positive_only:
        rows = rows.where(F.col("value") > 0)
    order, percent = None, None
    for i, b in enumerate(blocks, start=1):
        hit = (F.col("stat") == b.stat) & (F.col("var") == b.var)
        order = F.when(hit, i) if order is None else order.when(hit, i)
        percent = F.when(hit, b.percent) if percent is None else percent.when(hit, b.percent)
    text = F.when(percent, percent_text("value")).otherwise(number_text("value"))
    wide = (
        rows.withColumn("block", order)
        .where(F.col("block").isNotNull())
        .withColumn("category", F.coalesce("level", "var"))
        .withColumn("text", text)
        .groupBy("block", "category")
        .pivot("subpop", list(subpops))
        .agg(F.first("text"))
        .withColumnsRenamed(dict(subpops))
    )
    in_block = Window.partitionBy("block").orderBy("category")
    body = wide.withColumn("ord", F.row_number().over(in_block))
    labels = list(subpops.values())
    titles = estimates.sparkSession.createDataFrame(
        [(i, 0, b.title) for i, b in enumerate(blocks, start=1)], "block int, ord int, category string"
    ).withColumns({label: F.lit(None).cast("string") for label in labels})
    return titles.unionByName(body).select("block", "ord", "category", *labels)


def shares_report(estimates: DataFrame, var: str, subpop: str, period: Column, label: str) -> DataFrame:
    """Shares of one variable in one sub-population as percent text."""
    rows = estimates.where(period & (F.col("stat") == SHARE) & (F.col("var") == var) & (F.col("subpop") == subpop))
    return rows.select(F.col("level").alias("category"), percent_text("value").alias(label))


def regions_report(
    estimates: DataFrame, var: str, period: Column, regions: DataFrame, region_name: str
) -> DataFrame:
    """Regional shares with the attributes of each region and a whole-percent label."""
    rows = estimates.where(period & (F.col("stat") == SHARE) & (F.col("var") == var)).select(
        "subpop", F.col("level").alias("category"), "value", percent_text("value", 0).alias("label")
    )
    return lookup_join(rows, regions.withColumnRenamed(region_name, "category"), ["category"])


def coefficients_report(tables: Sequence[DataFrame], models: Sequence[str], digits: int = 3) -> DataFrame:
    """Models side by side: estimate, stars and standard error per term; NULL where a model lacks it."""
    long = reduce(DataFrame.unionByName, tables)
    stars = None
    for limit, mark in STAR_CUTOFFS:
        hit = F.col("p_value") < limit
        stars = F.when(hit, mark) if stars is None else stars.when(hit, mark)
    pattern = "0." + "0" * digits
    text = F.concat(
        decimal_text(F.bround("estimate", digits), pattern),
        stars.otherwise(""),
        F.lit(" ("),
        decimal_text(F.bround("std_error", digits), pattern),
        F.lit(")"),
    )
    return long.withColumn("text", text).groupBy("term").pivot("model", list(models)).agg(F.first("text"))


def mean_block(title: str, var: str, percent: bool = False) -> Block:
    return Block(title, var, MEAN, percent)
