"""Estimates from sums that are landed period by period."""

import pytest
from pyspark.sql import functions as F

from panelweave.operators.design import SurveyDesign
from panelweave.operators.estimate import Statistics, additive_sums, estimates, estimates_from_sums, merge_sums
from panelweave.sources import estimates as saved



def domains():
    return {"all": F.lit(True), "high": F.col("value") > 50}


def wanted():
    return Statistics(
        population=True, totals_by={"kind": F.col("kind")}, shares={"kind": F.col("kind")}, means={"value": F.col("value")},
        interactions={"both": ["kind", "side"]}, levels={"kind": ["a", "b", "c"], "side": ["l", "r", "none"]},
    )


@pytest.fixture
def design(spark):
    data = spark.range(900).select(
        (2020 + F.col("id") % 3).cast("int").alias("year"), (F.col("id") % 4).alias("stratum"), (F.col("id") % 7).alias("psu"),
        (1 + F.col("id") % 5).cast("double").alias("w"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 11 % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("id") % 13 < 6, "l").otherwise("r").alias("side"), (F.col("id") * 37 % 101).cast("double").alias("value"), "id",
    )
    return SurveyDesign(data, "w", "stratum", "psu", by=("year",))


def plain(frame):
    rows = [(r.year, r.subpop, r.stat, r["var"], str(r.level), *(round(x, 7) for x in list(r)[5:])) for r in frame.collect()]
    return sorted(rows)


@pytest.mark.parametrize("se", [None, "taylor"])
def test_years_in_steps_equal_one_step(spark, design, tmp_path, se):
    path = str(tmp_path / "sums")
    steps = [F.col("year") == 2020, (F.col("year") == 2021) & (F.col("id") < 300), F.col("year") >= 2021]
    for rows in steps:
        saved.write_sums(additive_sums(design.with_data(design.data.where(rows)), wanted(), domains()), path, ["year"])
    found = estimates_from_sums(design, saved.read_sums(spark, path), wanted(), list(domains()), se)
    assert plain(found) == plain(estimates(design, wanted(), domains(), se))


def test_parts_of_a_year_add_up(design):
    parts = [additive_sums(design.with_data(design.data.where(F.col("id") % 2 == i)), wanted(), domains()) for i in range(2)]
    found = estimates_from_sums(design, merge_sums(design, *parts), wanted(), list(domains()), "taylor")
    assert plain(found) == plain(estimates(design, wanted(), domains(), "taylor"))


def test_sub_populations_are_found_by_name(design):
    sums = additive_sums(design, wanted(), domains())
    high = {"high": domains()["high"]}
    assert plain(estimates_from_sums(design, sums, wanted(), ["high"])) == plain(estimates(design, wanted(), high))
    with pytest.raises(ValueError):
        estimates_from_sums(design, sums, wanted(), ["high"], "replicate")


def test_estimates_of_other_periods_stay(spark, design, tmp_path):
    path = str(tmp_path / "estimates")
    whole = estimates(design, Statistics(population=True, shares={"kind": F.col("kind")}))
    for year in (2021, 2020, 2022, 2021):
        saved.write_estimates(whole.where(F.col("year") == year), path, ["year"])
    found = saved.read_estimates(spark, path).select(*whole.columns)
    assert plain(found) == plain(whole)
    saved.write_estimates(whole.where("year = 2020"), path + "-all")
    saved.write_estimates(whole.where("year = 2021"), path + "-all")
    assert {r.year for r in saved.read_estimates(spark, path + "-all").select("year").distinct().collect()} == {2021}
