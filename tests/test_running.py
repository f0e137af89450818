"""Running sums over ranges, and what is built on them, with one time per row and an extreme one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators.model import Number
from panelweave.operators.running import RANGE, in_ranges, running_sums
from panelweave.operators.survival import fit_cox, km_curve, time_cuts

N = 3000


@pytest.fixture
def many_ranges(settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="12")


def lives(spark, seed=3):
    draw = np.random.default_rng(seed)
    times = [*range(1, N), 10**9]
    x = draw.normal(size=N)
    rows = [(t, int(draw.random() < 0.7), float(v), str(i % 2)) for i, (t, v) in enumerate(zip(draw.permutation(times).tolist(), x, strict=True))]
    return spark.createDataFrame(rows, "time long, status int, x double, grade string"), rows


@pytest.mark.parametrize("descending", [False, True])
def test_against_a_plain_window(spark, many_ranges, descending):
    rows = spark.range(N).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id")).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    found = running_sums(in_ranges(rows, ["g"], "t"), ["g"], "t", {"total": F.col("v")}, descending)
    order = sorted(((i % 3, i * i, i if i % 5 else 0) for i in range(N)), key=lambda r: -r[1] if descending else r[1])
    expected, running = {}, {}
    for g, t, v in order:
        running[g] = running.get(g, 0) + v
        expected[g, t] = running[g]
    assert {(r.g, r.t): r.total for r in found.collect()} == expected


def test_no_range_is_much_fuller_than_the_mean(spark, many_ranges):
    table, _ = lives(spark)
    sizes = [r["count"] for r in in_ranges(table, ["grade"], "time").groupBy(RANGE).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * N / len(sizes)
    cuts = time_cuts(table.select(F.col("time").cast("double")), 64)
    inside = np.bincount(np.searchsorted(cuts, [*range(1, N), 10**9], "left"))
    assert len(inside) == 64 and inside.max() <= 2 * N / 64


def test_few_times_have_few_cuts(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "time double")
    assert set(time_cuts(frame)) <= {1.0, 2.0, 3.0} and len(time_cuts(frame.where("time > 5"))) == 0


def test_curve_of_single_times(spark, many_ranges):
    table, rows = lives(spark)
    curve = km_curve(table, stratum=F.col("grade"), populations={"all": F.lit(True), "right": F.col("x") > 0})
    for population, member in (("all", lambda r: True), ("right", lambda r: r[2] > 0)):
        for grade in "01":
            mine = sorted(r for r in rows if r[3] == grade and member(r))
            found = curve.where((F.col("population") == population) & (F.col("stratum") == grade)).orderBy("time").collect()
            assert [(r.time, r.n_risk, r.n_event) for r in found] == [(r[0], len(mine) - i, r[1]) for i, r in enumerate(mine)]
            surv = np.cumprod([1 - r[1] / (len(mine) - i) for i, r in enumerate(mine)])
            assert np.allclose([r.surv for r in found], surv, rtol=1e-9, atol=1e-12)


def test_cox_of_single_times(spark):
    table, rows = lives(spark)
    fit = fit_cox(table, [Number("x", F.col("x"))])
    ordered = sorted(rows)
    event, x = np.array([r[1] for r in ordered], float), np.array([r[2] for r in ordered])
    after = lambda v: np.cumsum(v[::-1])[::-1]
    risk = np.exp(x * fit.coefficients["x"])
    mean = after(risk * x) / after(risk)
    assert fit.converged and abs((event * (x - mean)).sum()) < 1e-5
    information = (event * (after(risk * x * x) / after(risk) - mean**2)).sum()
    assert abs(fit.covariance[0, 0] - 1 / information) < 1e-9
