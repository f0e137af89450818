"""Sub-populations as boolean columns. NULL means not in the group, as in a filter."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The programme's ages and half of the monthly minimum wage.
AGES = (14, 24)
INCOME_LIMIT = 1320 / 2
WORK_AGES = (25, 40)
UNKNOWN_YEAR = 9999


def birth_year_known(year: Column, unknown: int = UNKNOWN_YEAR) -> Column:
    return year != unknown


def first_visit(visit: Column) -> Column:
    return visit == "1"


def equal_all(pairs: Iterable[tuple[Column, str]]) -> Column:
    """Every column equals its label, for example network = public and course = upper secondary."""
    return reduce(lambda a, b: a & b, [column == label for column, label in pairs])


def grade_in(grade: Column, grades: Sequence, or_missing: bool = False) -> Column:
    return grade.isin(*grades) | grade.isNull() if or_missing else grade.isin(*grades)


def target_quarterly(
    age: Column,
    in_course: Column,
    income_pc: Column,
    lives_alone: Column,
    ages: tuple[int, int] = AGES,
    income_limit: float = INCOME_LIMIT,
) -> Column:
    """Right age, attends the course, known income at or below the limit, not a one-person household."""
    return age.between(*ages) & in_course & _poor(income_pc, income_limit) & ~lives_alone


def potential_quarterly(
    age: Column,
    income_pc: Column,
    schooling: Column,
    levels: Sequence[str],
    ages: tuple[int, int] = AGES,
    income_limit: float = INCOME_LIMIT,
) -> Column:
    return age.between(*ages) & _poor(income_pc, income_limit) & schooling.isin(*levels)


def target_annual(
    age: Column,
    in_course: Column,
    income_pc: Column,
    benefits: Sequence[Column],
    lives_alone: Column,
    ages: tuple[int, int] = AGES,
    income_limit: float = INCOME_LIMIT,
) -> Column:
    """Like the quarterly form, but a benefit stands in for low income; a TRUE arm decides over a NULL one."""
    return age.between(*ages) & in_course & _poor_or_benefit(income_pc, benefits, income_limit) & ~lives_alone


def potential_annual(
    age: Column,
    income_pc: Column,
    benefits: Sequence[Column],
    schooling: Column,
    levels: tuple[str, str],
    ages: tuple[int, int] = AGES,
    income_limit: float = INCOME_LIMIT,
) -> Column:
    """The second schooling level admits any age and income: AND binds before OR in the published rule."""
    completed, started = levels
    return (age.between(*ages) & _poor_or_benefit(income_pc, benefits, income_limit) & (schooling == completed)) | (
        schooling == started
    )


def wage_sample(age: Column, sector: Column, public_sector: str, ages: tuple[int, int] = WORK_AGES) -> Column:
    """People of working age with a known sector that is not the public one."""
    return age.between(*ages) & (sector != public_sector)


def selection_sample(age: Column, sector: Column, public_sector: str, ages: tuple[int, int] = WORK_AGES) -> Column:
    """As the wage sample, with people of unknown sector (not employed) kept."""
    return age.between(*ages) & (sector.isNull() | (sector != public_sector))


def flag(condition: Column) -> Column:
    """A domain flag without NULL."""
    return F.coalesce(condition, F.lit(False))


def _poor(income_pc: Column, limit: float) -> Column:
    return income_pc.isNotNull() & (income_pc <= limit)


def _poor_or_benefit(income_pc: Column, benefits: Sequence[Column], limit: float) -> Column:
    return reduce(or_, benefits, income_pc <= limit)
