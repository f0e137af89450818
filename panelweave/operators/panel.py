"""Following people across waves.

Each operator makes one aggregate per person with the state of every wave side by side, so comparing
waves needs no wave-to-wave join. States are small whole numbers: they combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.skew import attach_groups, order_key

LEFT, ATTENDS, UNKNOWN = 0, 1, 2  # what a wave says about a person; an absent person has NULL

MOST_WAVES = 63  # the bits of a whole number, without its sign


def attendance_state(attends: Column, left: Column) -> Column:
    return F.when(attends, ATTENDS).when(left, LEFT).otherwise(UNKNOWN)


def wave_states(
    panel: DataFrame,
    person: str,
    wave: str,
    states: Mapping[str, tuple[int, Column]],
    order: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per person with each named state of its wave.

    With `order`, the last row of the person in the wave gives the state. Without it the largest state
    counts; operators code states so that attending outweighs having left.
    """

    def state(at: int, value: Column) -> Column:
        here = F.col(wave) == at
        if not order:
            return F.max(F.when(here, value))
        return F.max_by(value, F.when(here, order_key(order, panel.schema)))

    columns = [state(at, value).alias(name) for name, (at, value) in states.items()]
    return panel.groupBy(person).agg(*columns, *extra)


def packed_states(panel: DataFrame, person: str, wave: str, waves: Sequence[int], flags: Mapping[str, Column]) -> DataFrame:
    """One row per person with a whole number for each flag, whose bit i says whether any row of the i-th wave has it.

    Whatever the number of waves, up to the 63 bits of a number, the aggregate carries one number per flag. A NULL flag
    counts as not set. Rows of other waves are left out.
    """
    if len(waves) > MOST_WAVES or len(set(waves)) < len(waves):
        raise ValueError(f"packed states take at most {MOST_WAVES} different waves")
    place = F.array_position(F.array(*[F.lit(w) for w in waves]), F.col(wave)).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    rows = panel.where(F.col(wave).isin(*waves)).select(
        person, *[F.when(flag, bit).otherwise(F.lit(0).cast("long")).alias(name) for name, flag in flags.items()]
    )
    return rows.groupBy(person).agg(*[F.bit_or(name).alias(name) for name in flags])


def _packed_attendance(panel, person, wave, waves, start: Column, left: Column) -> DataFrame:
    flags = {"__start": start, "__seen": F.lit(True), "__stays": ~F.coalesce(left, F.lit(False))}
    return packed_states(panel, person, wave, waves, flags)


def _packed_survival(people: DataFrame, person: str, waves: Sequence[int]) -> DataFrame:
    """(person, status, time) from packed states: the lowest bit where a later wave doesn't stay ends the chain."""
    later = F.lit((1 << len(waves)) - 2).cast("long")
    broken = F.bitwise_not("__stays").bitwiseAND(later)
    lowest = broken.bitwiseAND(-broken)
    ended = people.where(F.col("__start").bitwiseAND(F.lit(1)) == 1).select(person, "__seen", lowest.alias("__end"))
    whole, gone = F.col("__end") == 0, F.col("__seen").bitwiseAND(F.col("__end")) != 0
    place = F.bit_count(F.col("__end") - 1)
    return ended.select(
        person,
        F.when(~whole & gone, 1).otherwise(0).cast("int").alias("status"),
        F.when(whole, len(waves)).when(gone, place + 1).otherwise(place).cast("int").alias("time"),
    )


def _packed_pairs(people: DataFrame, person: str, wave: str, waves: Sequence[int]) -> DataFrame:
    """(person, wave) for every bit that is set in a wave's start and, one place on, seen without staying."""
    left = F.col("__seen").bitwiseAND(F.bitwise_not("__stays"))
    hits = people.select(person, F.col("__start").bitwiseAND(F.shiftright(left, 1)).alias("__hits")).where("__hits <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(len(waves) - 1)), lambda i: F.call_function("getbit", F.col("__hits"), i) == 1)
    each = F.transform(places, lambda i: F.array(*[F.lit(w) for w in waves])[i])
    return hits.select(person, F.explode(each).alias(wave))


def baseline_cohort(panel: DataFrame, wave: str, first_wave: int, conditions: Sequence[Column]) -> DataFrame:
    """The people of the first wave who meet every condition."""
    return panel.where(reduce(and_, conditions, F.col(wave) == first_wave))


def survival_table(
    panel: DataFrame,
    person: str,
    wave: str,
    waves: Sequence[int],
    baseline: Column,
    left: Column,
    order: Sequence[str] = (),
) -> DataFrame:
    """(person, status, time) for the baseline cohort of the first wave.

    The chain stops at the first drop-out (status 1, time = that wave) or the first absence (status 0,
    time = the wave before). Who is still there in the last wave is censored at it. An attendance that
    is not a clear drop-out, missing included, goes on. Times count waves from 1. Without an order, waves are bits of
    one number.
    """
    if not order and len(waves) <= MOST_WAVES:
        return _packed_survival(_packed_attendance(panel, person, wave, waves, baseline, left), person, waves)
    first, *later = waves
    states = {"__base": (first, F.when(baseline, 1).otherwise(0))}
    for w in later:
        states[f"__w{w}"] = (w, F.when(left, LEFT).otherwise(ATTENDS))
    people = wave_states(panel.where(F.col(wave).isin(*waves)), person, wave, states, order)

    status, time = None, None
    for position, w in enumerate(later, start=2):
        seen = F.col(f"__w{w}")
        if status is None:
            status, time = F.when(seen.isNull(), 0), F.when(seen.isNull(), position - 1)
        else:
            status, time = status.when(seen.isNull(), 0), time.when(seen.isNull(), position - 1)
        status, time = status.when(seen == LEFT, 1), time.when(seen == LEFT, position)
    return people.where(F.col("__base") == 1).select(
        person,
        status.otherwise(0).cast("int").alias("status"),
        time.otherwise(len(waves)).cast("int").alias("time"),
    )


def pair_dropouts(
    panel: DataFrame,
    person: str,
    wave: str,
    waves: Sequence[int],
    eligible: Column,
    attends: Column,
    left: Column,
    order: Sequence[str] = (),
) -> DataFrame:
    """(person, wave) for everyone eligible and attending in a wave who has left by the next one.

    All consecutive pairs come from one pass. Only the earlier wave must be eligible. Without an order, waves are bits
    of one number.
    """
    if not order and len(waves) <= MOST_WAVES:
        return _packed_pairs(_packed_attendance(panel, person, wave, waves, eligible & attends, left), person, wave, waves)
    states: dict[str, tuple[int, Column]] = {}
    for w in waves:
        states[f"__from{w}"] = (w, F.when(eligible & attends, 1).otherwise(0))
        states[f"__to{w}"] = (w, F.when(left, LEFT).otherwise(ATTENDS))
    people = wave_states(panel.where(F.col(wave).isin(*waves)), person, wave, states, order)
    hits = [
        F.when((F.col(f"__from{a}") == 1) & (F.col(f"__to{b}") == LEFT), F.lit(a))
        for a, b in zip(waves, waves[1:], strict=False)
    ]
    return people.select(person, F.explode(F.array_compact(F.array(*hits))).alias(wave))


def matched_waves(
    panel: DataFrame, person: str, wave: str, waves: tuple[int, int], states: Mapping[str, Column], order: Sequence[str] = ()
) -> DataFrame:
    """People seen in both waves, with every state of the first as `<name>_x` and of the second as `<name>_y`."""
    first, second = waves
    wanted = {f"{n}_x": (first, c) for n, c in states.items()} | {f"{n}_y": (second, c) for n, c in states.items()}
    present = {"__x": (first, F.lit(1)), "__y": (second, F.lit(1))}
    people = wave_states(panel.where(F.col(wave).isin(first, second)), person, wave, wanted | present, order)
    return people.where(F.col("__x").isNotNull() & F.col("__y").isNotNull()).drop("__x", "__y")


def rows_of(rows: DataFrame, people: DataFrame, keys: Sequence[str], keep: bool = True) -> DataFrame:
    """Full rows of the listed keys (or, with keep=False, of everyone else)."""
    return attach_groups(rows, people.select(*keys).distinct(), keys, "left_semi" if keep else "left_anti")


def attrition(
    panel: DataFrame, person: str, wave: str, waves: tuple[int, int], baseline: Column, order: Sequence[str] = ()
) -> DataFrame:
    """Baseline people of the first wave who are absent from the second."""
    first, second = waves
    states = {"__base": (first, F.when(baseline, 1).otherwise(0)), "__next": (second, F.lit(1))}
    people = wave_states(panel.where(F.col(wave).isin(first, second)), person, wave, states, order)
    return people.where((F.col("__base") == 1) & F.col("__next").isNull()).select(person)


def evasion_flags(
    panel: DataFrame,
    person: str,
    wave: str,
    waves: tuple[int, int],
    baseline: Column,
    follow_up: Column,
    attends: Column,
    left: Column,
    last_grade: Column,
    grade_missing: Column,
    order: Sequence[str] = (),
) -> DataFrame:
    """(person, evaded) for people in scope in both waves.

    1 for who attended and then left; back to 0 for who was in the last grade and has no grade later
    (graduated).
    """
    first, second = waves
    states = {
        "__scope": (first, F.when(baseline, 1).otherwise(0)),
        "__attended": (first, F.when(attends, 1).otherwise(0)),
        "__final": (first, F.when(last_grade, 1).otherwise(0)),
        "__follow": (second, F.when(follow_up, 1).otherwise(0)),
        "__left": (second, F.when(left, LEFT).otherwise(ATTENDS)),
        "__nograde": (second, F.when(grade_missing, 1).otherwise(0)),
    }
    people = wave_states(panel.where(F.col(wave).isin(first, second)), person, wave, states, order)
    gone = (F.col("__attended") == 1) & (F.col("__left") == LEFT)
    graduated = (F.col("__final") == 1) & (F.col("__nograde") == 1)
    return people.where((F.col("__scope") == 1) & (F.col("__follow") == 1)).select(
        person, F.when(gone & ~graduated, 1).otherwise(0).alias("evaded")
    )


def with_covariates(outcomes: DataFrame, covariates: DataFrame, person: str) -> DataFrame:
    """Outcomes joined to the covariates of the same people; both sides have one row per person."""
    return outcomes.join(covariates, person, "inner")
