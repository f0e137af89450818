"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose values are whole numbers of at most 18 digits.
SHORT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.ByteType, T.ShortType, T.IntegerType)


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per group (`groups` has unique `keys`) back to the rows of that group.

    A grouped aggregate is already partitioned by its key, and Spark would join on that partitioning
    as it stands; adaptive execution can then not split a partition that one large group fills. The
    extra equality on a hash of the keys asks for a fresh exchange on both sides, which skew handling
    does split, so a group of any size is spread over many tasks. A `groups` side below the broadcast
    threshold is still broadcast, by its measured size. `how` is left, inner, left_semi or left_anti.
    """
    renamed = groups.withColumnsRenamed({k: _right(k) for k in keys})
    right_keys = [_right(k) for k in keys]
    same = reduce(and_, [F.col(k) == F.col(_right(k)) for k in keys])
    route = F.xxhash64(*keys) == F.xxhash64(*right_keys)
    return rows.join(renamed, same & route, how).drop(*right_keys)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a lookup table with unique keys; Spark broadcasts it if its measured size allows."""
    return attach_groups(rows, lookup, keys)


def order_key(columns: Sequence[str], schema: T.StructType | None = None) -> Column:
    """One sortable value from several columns, missing values first.

    A time, date or short whole number followed by another whole number is packed into one number, which keeps the aggregate in hash
    mode; anything else becomes a struct, by which an aggregate sorts.
    """
    if len(columns) == 1:
        return F.col(columns[0])
    kinds = [schema[c].dataType for c in columns] if schema else []
    if len(kinds) == 2 and isinstance(kinds[0], SHORT) and isinstance(kinds[1], (*SHORT, T.LongType)):
        first, second = (_whole(c, k) for c, k in zip(columns, kinds, strict=True))
        high = F.coalesce(first.cast("decimal(18,0)"), F.lit("-900000000000000000").cast("decimal(18,0)"))
        low = F.coalesce(second.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
        return (high * F.lit(str(2**65)).cast("decimal(20,0)") + low).cast("decimal(38,0)")
    return F.struct(*columns)


def _whole(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{name}`)")
    return F.col(name)


def _right(key: str) -> str:
    return f"__group_{key}"
