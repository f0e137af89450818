"""Household measures put back on every person: real income per head and the parents' schooling.

One grouped aggregate per household combines on the map side, so a very large household reaches the
shuffle as one partial row per task; the result returns to the people through `attach_groups`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.scalars import member_flag, members_only, real_income
from panelweave.operators.skew import attach_groups, order_key

INCOME_COLUMNS = ("members", "income_own", "income_last", "pc_own", "pc_last")
PARENT_COLUMNS = ("mother_edu", "father_edu", "parent_max")
# Relation codes head, spouse, parent; sex codes.
PARENT_RELATIONS = (1, 2, 6)
MOTHER_SEX = 2
FATHER_SEX = 1


@dataclass(frozen=True)
class IncomeSource:
    """One kind of income with its deflators to the survey's own year and to the last year."""

    amount: Column
    deflator_own: Column
    deflator_last: Column


@dataclass(frozen=True)
class IncomeRoles:
    relation: Column
    excluded: Sequence[str]
    sources: Sequence[IncomeSource]


@dataclass(frozen=True)
class ParentRoles:
    sex_code: Column
    relation_code: Column
    schooling_code: Column
    order: Sequence[str]  # columns giving people a total order inside the household
    parent_relations: Iterable[int] = PARENT_RELATIONS


def household_profile(
    persons: DataFrame,
    household: str | Sequence[str],
    income: IncomeRoles | None = None,
    parents: ParentRoles | None = None,
) -> DataFrame:
    """Add INCOME_COLUMNS and/or PARENT_COLUMNS to every person, with one aggregate for both.

    `household` is the key column, or several when a household recurs in other waves or years.
    """
    keys = [household] if isinstance(household, str) else list(household)
    aggregates = _income_sums(income) if income is not None else []
    if parents is not None:
        aggregates += _first_parents(parents, persons.schema)
    groups = persons.groupBy(*keys).agg(*aggregates)
    if income is not None:
        groups = groups.withColumns(
            {
                "pc_own": F.try_divide("income_own", "members"),
                "pc_last": F.try_divide("income_last", "members"),
            }
        )
    if parents is not None:
        groups = groups.withColumn("parent_max", F.greatest("mother_edu", "father_edu"))
    joined = attach_groups(persons, groups, keys)
    if income is None:
        return joined
    hidden = ("income_own", "income_last", "pc_own", "pc_last")
    return joined.withColumns({c: members_only(c, income.relation, income.excluded) for c in hidden})


def household_income(persons: DataFrame, household: str, income: IncomeRoles) -> DataFrame:
    return household_profile(persons, household, income=income)


def parents_schooling(persons: DataFrame, household: str, parents: ParentRoles) -> DataFrame:
    return household_profile(persons, household, parents=parents)


def _income_sums(income: IncomeRoles) -> list[Column]:
    member = member_flag(income.relation, income.excluded)

    def total(deflators: Iterable[Column]) -> Column:
        sums = [
            F.coalesce(F.sum(real_income(source.amount, member, deflator)), F.lit(0.0))
            for source, deflator in zip(income.sources, deflators, strict=True)
        ]
        out = sums[0]
        for s in sums[1:]:
            out = out + s
        return out

    return [
        F.coalesce(F.sum(member), F.lit(0.0)).alias("members"),
        total(s.deflator_own for s in income.sources).alias("income_own"),
        total(s.deflator_last for s in income.sources).alias("income_last"),
    ]


def _first_parents(parents: ParentRoles, schema: T.StructType) -> list[Column]:
    """Schooling of the first mother-like and father-like person of the household.

    The first match counts even when its schooling is unknown. A person whose membership is unknown
    and who comes before the first match makes the answer unknown.
    """
    position = order_key(parents.order, schema)
    is_parent = parents.relation_code.isin(*parents.parent_relations)

    def first(sex: int) -> Column:
        match = (parents.sex_code == sex) & is_parent
        # min_by keeps a NULL schooling of the earliest row, and skips rows without a position.
        # A household where nobody matches for certain has no such parent, known or not.
        earliest = F.min_by(F.when(match, parents.schooling_code), F.when(match | match.isNull(), position))
        return F.when(F.max(match), earliest)

    return [first(MOTHER_SEX).alias("mother_edu"), first(FATHER_SEX).alias("father_edu")]
