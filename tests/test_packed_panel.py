import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel

SCHEMA = "person int, wave int, base boolean, attends boolean, gone boolean, turn int"


def rows(waves, people=60, seed=9, several=False):
    """Random people with gaps, missing flags and, with `several`, more rows of a person in a wave."""
    draw = np.random.default_rng(seed)
    pick = lambda p: [True, False, None][draw.choice(3, p=p)]
    out = []
    for person in range(people):
        for wave in waves:
            for turn in range(int(draw.choice([1, 2, 3])) if several else 1):
                if draw.random() < 0.97:
                    out.append((person, int(wave), pick([0.8, 0.1, 0.1]), pick([0.7, 0.2, 0.1]), pick([0.03, 0.9, 0.07]), turn))
    return out


def by_hand(data, waves):
    """Survival and drop-outs from plain dictionaries."""
    seen = {}
    for person, wave, base, attends, gone, _ in data:
        if wave in waves:
            state = seen.setdefault((person, wave), [False, False, False])
            state[0] |= bool(base)
            state[1] |= bool(base and attends)
            state[2] |= gone is not True
    survival, pairs = [], []
    for person in sorted({p for p, _ in seen}):
        if seen.get((person, waves[0]), [False])[0]:
            status, time = 0, len(waves)
            for at, wave in enumerate(waves[1:], start=2):
                if (person, wave) not in seen:
                    time = at - 1
                    break
                if not seen[person, wave][2]:
                    status, time = 1, at
                    break
            survival.append((person, status, time))
        for a, b in zip(waves, waves[1:], strict=False):
            if seen.get((person, a), [0, False])[1] and (person, b) in seen and not seen[person, b][2]:
                pairs.append((person, a))
    return survival, pairs


@pytest.mark.parametrize(("count", "several"), [(1, True), (2, False), (2, True), (7, True), (60, True), (63, False)])
def test_equals_plain_chains(spark, count, several):
    waves = [10 + 3 * i for i in range(count)]
    data = rows([*waves, 1, 11], several=several)
    frame = spark.createDataFrame(data, SCHEMA)
    columns = [F.col("base"), F.col("gone")]
    survival, pairs = by_hand(data, waves)
    assert sorted(map(tuple, panel.survival_table(frame, "person", "wave", waves, *columns).collect())) == survival
    found = panel.pair_dropouts(frame, "person", "wave", waves, F.col("base"), F.col("attends"), F.col("gone"))
    assert sorted(map(tuple, found.collect())) == sorted(pairs)


def test_more_waves_than_bits_and_an_order_give_the_same(spark):
    waves = list(range(1, 71))
    data = rows(waves, people=20)
    frame = spark.createDataFrame(data, SCHEMA)
    survival, pairs = by_hand(data, waves)
    assert sorted(map(tuple, panel.survival_table(frame, "person", "wave", waves, F.col("base"), F.col("gone")).collect())) == survival
    for order in ((), ("turn",)):
        found = panel.pair_dropouts(frame, "person", "wave", waves[:9], F.col("base"), F.col("attends"), F.col("gone"), order)
        assert sorted(map(tuple, found.collect())) == sorted(p for p in pairs if p[1] < 9)


def test_one_exchange_of_few_numbers(spark):
    frame = spark.createDataFrame(rows(range(1, 61), people=3), SCHEMA)
    made = panel.survival_table(frame, "person", "wave", list(range(1, 61)), F.col("base"), F.col("gone"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and plan.count("bit_or(__") <= 6 * 2


def test_refused_waves_and_empty_panel(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for waves in ([1, 1], list(range(64))):
        with pytest.raises(ValueError, match="waves"):
            panel.packed_states(frame, "person", "wave", waves, {"a": F.lit(True)})
    assert panel.survival_table(frame, "person", "wave", [1, 2], F.col("base"), F.col("gone")).count() == 0
