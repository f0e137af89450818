"""The survey studies on the survey view of the given tables, against plain recomputation."""

import pytest
from pyspark.sql import functions as F

from panelweave.plans import studies, survey, survey_view


@pytest.fixture(scope="module")
def waves(spark, medium_dir):
    return survey_view.waves(spark, medium_dir)


def test_dropout_study_counts(waves):
    results = studies.dropout_study(waves, [1, 2, 3, 4], se=None, lonely_psu="remove")
    got = {(r["wave"], r["subpop"]): r["value"] for r in results.where("stat = 'total'").collect()}
    people = waves.select("V1008", "wave", "weight", "V1016", "V20082", "V3002").toPandas()
    for wave in (1, 2, 3):
        now = people[(people.wave == wave) & (people.V1016 == "1") & (people.V20082 != 9999)]
        then = people[(people.wave == wave + 1) & (people.V3002 == "Não")]
        gone = now[(now.V3002 == "Sim") & now.V1008.isin(then.V1008)]
        assert got[wave, "first_visit"] == pytest.approx(now.weight.sum())
        assert got[wave, "attending"] == pytest.approx(now[now.V3002 == "Sim"].weight.sum())
        assert got[wave, "dropout"] == pytest.approx(gone.weight.sum())


def test_survival_study_tables(waves):
    out = studies.survival_study(waves, [1, 2, 3, 4], lonely_psu="remove")
    survived = out["survival"].collect()
    assert len({r["person_id"] for r in survived}) == len(survived) > 0
    overall = out["curves"].where("population = 'all'").orderBy("time").collect()
    assert overall[0]["n_risk"] == len(survived)
    for name in ("cox", "probit"):
        models = {r["model"]: r["converged"] for r in out[name].collect()}
        assert set(models) == {"cohort", "target", "potential"} and all(models.values())


def test_characterisation_matches_a_separate_estimate(spark, small_dir):
    annual = survey_view.annual(spark, small_dir)
    results = studies.characterisation_study(annual)
    public = annual.where("V3002A = 'Rede pública' AND V2007 IS NOT NULL")
    expected = {
        (r["year"], r["V2007"]): r["share"]
        for r in public.groupBy("year", "V2007").agg(F.sum("weight").alias("w")).selectExpr(
            "year", "V2007", "w / sum(w) OVER (PARTITION BY year) AS share"
        ).collect()
    }
    got = results.where("subpop = 'public_school' AND var = 'V2007'").collect()
    assert {(r["year"], r["level"]): r["value"] for r in got} == pytest.approx(expected)
    per_year = results.groupBy("year").agg(F.countDistinct("subpop", "stat", "var")).collect()
    assert all(r[1] == 3 * (1 + 15 + 2 + 2) for r in per_year)


def test_reports_and_wages(spark, small_dir, tmp_path):
    annual = survey_view.annual(spark, small_dir)
    studies.characterisation_study(annual).write.parquet(str(tmp_path / "estimates"))
    results = spark.read.parquet(str(tmp_path / "estimates"))
    regions = spark.createDataFrame([("Norte", 1), ("Sul", 4)], "nome string, code int")
    reports = studies.characterisation_reports(results, regions, "nome", 2022, 2023)
    assert set(reports) == {"totals", "demographics", "dwelling", "attendance", "household_types", "regions"}
    assert all(r.count() > 0 for r in reports.values())
    assert reports["regions"].where("category = 'Norte' AND code = 1").count() > 0
    tables = studies.wage_study(annual.where("year = 2023"), seed=3, lonely_psu="remove")
    assert tables["outcome"].where("term = 'mills'").count() == 1
    assert tables["mincer_table"].where("term = '(Intercept)'").first()["mincer_potential"] is not None


def test_evasion_study(waves):
    out = studies.evasion_study(waves, (1, 2), lonely_psu="remove")
    assert {r[0] for r in out["evasion"].select("evaded").distinct().collect()} == {0, 1}
    assert out["probit"].where("converged").select("model").distinct().count() >= 1


def test_levels_of_any_number(spark):
    levels = survey.observed_levels(spark.range(1500).selectExpr("CAST(id AS STRING) AS x"), ["x"])
    assert len(levels["x"]) == 1500
