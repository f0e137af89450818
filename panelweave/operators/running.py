"""Running sums over an ordered table that no single task could hold.

Rows are dealt into ranges of the order, about equally full, and written with their range's number. A running sum is
then the sums of all earlier ranges plus a window inside the range: every task holds one range, and the table of
ranges has one row per group and range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import checkpointed

RANGE = "__range"


def in_ranges(rows: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """`rows` with the number of their range of (groups, order), written once; equal values share a range.

    Cuts follow a sample of the rows, so one extreme value doesn't widen a range, and a group with many rows spans many
    ranges. Small neighbouring ranges become one.
    """
    return checkpointed(rows.repartitionByRange(*groups, order).withColumn(RANGE, F.spark_partition_id()))


def running_sums(rows: DataFrame, groups: Sequence[str], order: str, sums: Mapping[str, Column], descending: bool = False) -> DataFrame:
    """Add each of `sums`, added up over the rows of the group from the first in order (the last with `descending`) to this one.

    `rows` come from `in_ranges` over these groups or coarser ones, with at most one row per group and value of `order`.
    """
    groups = list(groups)
    turned = lambda name: F.col(name).desc() if descending else F.col(name).asc()
    earlier = Window.partitionBy(*groups).orderBy(turned(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*groups, RANGE).orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = rows.groupBy(*groups, RANGE).agg(*[F.sum(c).alias(f"__all_{name}") for name, c in sums.items()])
    before = ranges.select(*groups, RANGE, *[F.coalesce(F.sum(f"__all_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums])
    names = list(rows.columns)
    inside = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__inside_{name}") for name, c in sums.items()])
    return inside.join(before, [*groups, RANGE]).select(*names, *[(F.col(f"__before_{name}") + F.col(f"__inside_{name}")).alias(name) for name in sums])
