"""Reading survey microdata that has already landed as files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.skew import lookup_join


@dataclass(frozen=True)
class FixedField:
    """One field of a fixed-width record; `start` counts from 1."""

    name: str
    start: int
    width: int
    type: str = "string"


def read_quarters(
    spark: SparkSession, path: str, periods: Mapping[int, Sequence[int]], columns: Sequence[str] | None = None
) -> DataFrame:
    """Quarterly waves from a dataset partitioned by (year, quarter), with a running `wave` number from 1.

    All waves are one read; the filter prunes the partitions of other periods.
    """
    wanted = [(year, quarter) for year in sorted(periods) for quarter in sorted(periods[year])]
    wave, pick = None, None
    for number, (year, quarter) in enumerate(wanted, start=1):
        here = (F.col("year") == year) & (F.col("quarter") == quarter)
        wave = F.when(here, number) if wave is None else wave.when(here, number)
        pick = here if pick is None else pick | here
    rows = spark.read.parquet(path).where(pick)
    if columns is not None:
        rows = rows.select("year", "quarter", *columns)
    return rows.withColumn("wave", wave)


def read_annual(
    spark: SparkSession, path: str, years: Iterable[int], visit: int = 1, columns: Sequence[str] | None = None
) -> DataFrame:
    """Annual files of one visit from a dataset partitioned by (year, visit)."""
    rows = spark.read.parquet(path).where(F.col("year").isin(*years) & (F.col("visit") == visit))
    return rows if columns is None else rows.select("year", *columns)


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[FixedField]) -> DataFrame:
    """Raw fixed-width records as typed columns; blanks and unreadable numbers become NULL."""
    lines = spark.read.text(path)
    columns = []
    for field in layout:
        text = F.trim(F.substring("value", field.start, field.width))
        text = F.when(text != "", text)
        columns.append((text if field.type == "string" else text.try_cast(field.type)).alias(field.name))
    return lines.select(*columns)


@dataclass(frozen=True)
class RawRecords:
    """Raw records told apart: `good` has the period and the typed fields, `bad` the period, file, line and problem."""

    good: DataFrame
    bad: DataFrame
    all: DataFrame
    period: tuple[str, ...]

    def counts(self) -> DataFrame:
        """(period, problem, n): the records of every period, good ones with problem NULL, in one pass."""
        return self.all.groupBy(*self.period, "problem").agg(F.count(F.lit(1)).alias("n"))


def read_raw_periods(
    spark: SparkSession,
    path: str,
    layout: Sequence[FixedField],
    pattern: str,
    period: Sequence[str] = ("year", "quarter"),
    periods: Sequence[Sequence[int]] | None = None,
) -> RawRecords:
    """Fixed-width records of several periods, each period known from its file's path.

    `pattern` has one named group of digits for each column of `period`. With `periods`, files of other periods aren't
    opened: the condition is on the path, which Spark checks when it lists the files. A record is bad if its file names no
    period, if it is shorter or longer than the layout, or if a field that should be a number is neither blank nor one;
    the first of these is its `problem`. Blank fields are NULL.
    """
    groups = re.compile(pattern).groupindex
    if set(groups) != set(period):
        raise ValueError(f"the pattern must name the groups {list(period)}")
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    file = F.col("_metadata.file_path")
    of_file = {name: F.regexp_extract(file, plain, groups[name]).try_cast("int") for name in period}
    lines = spark.read.text(path)
    if periods is not None:
        here = [reduce(and_, [of_file[n] == v for n, v in zip(period, wanted, strict=True)]) for wanted in periods]
        lines = lines.where(reduce(or_, here, F.lit(False)))
    width = max(f.start + f.width - 1 for f in layout)
    raw, typed, unreadable = {}, {}, []
    for field in layout:
        text = F.trim(F.substring("value", field.start, field.width))
        raw[field.name] = F.when(text != "", text)
        typed[field.name] = raw[field.name] if field.type == "string" else raw[field.name].try_cast(field.type)
        if field.type != "string":
            unreadable.append((field.name, raw[field.name].isNotNull() & typed[field.name].isNull()))
    problem = F.when(reduce(or_, [of_file[n].isNull() for n in period]), "no period")
    problem = problem.when(F.length("value") < width, "short").when(F.length("value") > width, "long")
    for name, broken in unreadable:
        problem = problem.when(broken, f"unreadable {name}")
    told = lines.select(*[c.alias(n) for n, c in of_file.items()], file.alias("file"), "value", problem.alias("problem"))
    return RawRecords(
        good=told.where(F.col("problem").isNull()).select(*period, *[c.alias(n) for n, c in typed.items()]),
        bad=told.where(F.col("problem").isNotNull()).select(*period, "file", F.col("value").alias("line"), "problem"),
        all=told.select(*period, "problem"),
        period=tuple(period),
    )


def decode_labels(rows: DataFrame, dictionary: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Replace codes by labels; the code stays in `<name>_code`. An unknown code has a NULL label.

    `dictionary` has (var, code, label). A code with two labels is refused, whatever the dictionary's size.
    """
    rows = rows.withColumnsRenamed({v: f"{v}_code" for v in variables})
    for v in variables:
        code, label = F.col("code").cast("string"), F.col("label")
        several = F.raise_error(F.concat(F.lit(f"two labels of {v} for code "), F.coalesce("__code", F.lit("NULL"))))
        one = (
            dictionary.where(F.col("var") == v)
            .groupBy(code.alias("__code"))
            .agg(F.min(label).alias("__least"), F.max(label).alias("__most"))
            .select("__code", F.when(F.col("__least") != F.col("__most"), several.cast("string")).otherwise(F.col("__least")).alias(v))
        )
        rows = lookup_join(rows.withColumn("__code", F.col(f"{v}_code").cast("string")), one, ["__code"]).drop("__code")
    return rows


def attach_deflators(rows: DataFrame, deflators: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price deflators by period and area, one each; a missing one stays NULL."""
    return lookup_join(rows, deflators, keys)


def write_microdata(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Land microdata partitioned by period, which is what the readers prune on."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)
