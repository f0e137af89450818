"""Post-stratified standard errors against scores written out cluster by cluster."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.estimate import Statistics, estimates

TOTALS = {"a": 500.0, "b": 900.0, "c": 250.0}


def survey(seed=1, n=600):
    draw = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "year": draw.integers(2020, 2022, n), "stratum": draw.integers(0, 4, n), "psu": draw.integers(0, 5, n), "g": draw.choice(list("abc"), n),
        "w": draw.uniform(0.5, 3.0, n).round(3), "kind": draw.choice(["x", "y", "z"], n), "income": draw.normal(100, 30, n).round(2),
        "inside": draw.random(n) < 0.4,
    })
    # A sub-population that lives in one cluster, and a category found in one post-stratum only.
    frame.loc[(frame.stratum == 0) & (frame.psu == 0), "kind"] = "x"
    frame.loc[(frame.kind == "z") & (frame.g != "c"), "kind"] = "y"
    return frame


def scores_error(frame, top, bottom):
    """The error of sum(w top) / sum(w bottom), or of the total without a bottom, from the scores of all clusters."""
    y, x = frame.w * top, frame.w * (bottom if bottom is not None else 0.0)
    ratio = y.sum() / x.sum() if bottom is not None else 0.0
    u = (top - ratio * bottom) / x.sum() if bottom is not None else top
    mean = (frame.w * u).groupby(frame.g).sum() / frame.w.groupby(frame.g).sum()
    z = (frame.w * (u - frame.g.map(mean))).groupby([frame.stratum, frame.psu]).sum()
    variance = 0.0
    for _, part in z.groupby(level=0):
        n = len(part)
        variance += n / (n - 1) * ((part - part.mean()) ** 2).sum()
    return y.sum() / x.sum() if bottom is not None else y.sum(), np.sqrt(variance)


def test_against_scores(spark):
    data = survey()
    design = SurveyDesign(spark.createDataFrame(data), "w", "stratum", "psu", by=("year",))
    adjusted = poststratify(design, "g", TOTALS)
    wanted = Statistics(
        population=True, totals_by={"group": F.col("g"), "kind": F.col("kind")}, shares={"kind": F.col("kind")},
        means={"income": F.when(F.col("kind") != "x", F.col("income"))},
    )
    domains = {"all": F.lit(True), "inside": F.col("inside"), "one": (F.col("stratum") == 0) & (F.col("psu") == 0)}
    found = {(r.year, r.subpop, r.stat, r["var"], r.level): (r.value, r.std_error) for r in estimates(adjusted, wanted, domains, "taylor").collect()}
    expected = {}
    for year, frame in data.groupby("year"):
        frame = frame.assign(w=frame.w * frame.g.map(TOTALS) / frame.g.map(frame.w.groupby(frame.g).sum()))
        for name, member in (("all", frame.w > 0), ("inside", frame.inside), ("one", (frame.stratum == 0) & (frame.psu == 0))):
            here = member.astype(float)
            expected[year, name, "total", "count", None] = scores_error(frame, here, None)
            for var, column in (("group", frame.g), ("kind", frame.kind)):
                for level in sorted(set(column[member])):
                    is_level = here * (column == level)
                    expected[year, name, "total_by", var, level] = scores_error(frame, is_level, None)
                    if var == "kind":
                        expected[year, name, "share", var, level] = scores_error(frame, is_level, here)
            known = here * (frame.kind != "x")
            if known.sum():
                expected[year, name, "mean", "income", None] = scores_error(frame, known * frame.income, known)
    assert found.keys() == expected.keys()
    for key, (value, error) in expected.items():
        assert abs(found[key][0] - value) <= 1e-9 * abs(value), key
        assert abs(found[key][1] - error) <= 1e-6 * abs(error) + 1e-9 * abs(value), (key, found[key], error)


def test_known_totals_have_no_error(spark):
    adjusted = poststratify(SurveyDesign(spark.createDataFrame(survey(2)), "w", "stratum", "psu"), "g", TOTALS)
    rows = estimates(adjusted, Statistics(population=True, totals_by={"g": F.col("g")}), se="taylor").collect()
    assert {r.level: r.std_error for r in rows} == {None: 0.0, "a": 0.0, "b": 0.0, "c": 0.0}


def test_sub_populations_of_one_cluster_among_many(spark):
    n = 4000
    data = spark.range(n).select(
        (F.col("id") % 10).alias("stratum"), F.col("id").alias("psu"), F.lit("a").alias("g"), F.lit(1.0).alias("w"),
    )
    adjusted = poststratify(SurveyDesign(data, "w", "stratum", "psu"), "g", {"a": float(n)})
    domains = {f"d{i}": F.col("psu") == i for i in range(20)}
    found = estimates(adjusted, Statistics(population=True), domains, "taylor")
    assert found.count() == 20
    # The score is 1 - 1/n in one cluster and -1/n in all others.
    size = n // 10
    expected = np.sqrt(size / (size - 1) * (1 - 1 / size))
    assert all(abs(r.std_error - expected) < 1e-9 for r in found.collect())
