"""The survey studies end to end: each takes survey rows and returns finished tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import hourly_wage, is_employed, log_or_zero, missing_as_zero
from panelweave.operators import audience, panel, report
from panelweave.operators.estimate import Statistics, estimates
from panelweave.operators.glm import fit_linear, fit_probits, residuals
from panelweave.operators.model import Factor, Number, Term
from panelweave.operators.selection import heckman_two_step, impute_outcome
from panelweave.operators.skew import attach_groups
from panelweave.operators.survival import fit_cox, km_curve
from panelweave.plans.survey import (
    GRADES,
    NO,
    PUBLIC_SECTOR,
    RACE_LEVELS,
    REGIONS,
    SURVEY,
    YES,
    SurveyColumns,
    annual_domains,
    factor,
    in_course,
    observed_levels,
    person_key,
    quarterly_domains,
    survey_design,
    with_household_profile,
)
from panelweave.session import checkpointed, staged

SUBPOPS = {"target": "Eligible now", "potential": "Could become eligible", "public_school": "In public schools"}


def _attends(c: SurveyColumns) -> Column:
    return F.col(c.attends) == YES


def _has_left(c: SurveyColumns) -> Column:
    return F.col(c.attends) == NO


def _valid_waves(waves: DataFrame, c: SurveyColumns) -> DataFrame:
    return waves.withColumn("person_id", person_key(c)).where(audience.birth_year_known(F.col(c.birth[2])))


def _baseline_with_outcome(waves: DataFrame, outcome: DataFrame, c: SurveyColumns, wave: int, keep: Column) -> DataFrame:
    """Baseline rows with household profile and the person's outcome.

    The profile needs the whole household, so it comes before the filter on people.
    """
    profiled = with_household_profile(waves.where(F.col("wave") == wave), c, annual=False)
    people = _valid_waves(profiled, c).where(keep)
    return attach_groups(people, outcome, ["person_id"], "inner")


def _model_columns(rows: DataFrame, c: SurveyColumns, *extra: str) -> DataFrame:
    """Only what the designs, groups and models read: a survey row is wide, and these rows get written."""
    names = [
        c.strata, c.psu, c.weight, c.poststratum, c.poststratum_total, c.age, c.sex, c.area, c.residents, "race", "region",
        "pc_last", "parent_max", c.network, c.course, c.household_type, c.schooling_level, *extra,
    ]
    wanted = [x for n in names if n for x in (n, f"{n}_code") if x in rows.columns]
    return rows.select(*dict.fromkeys(wanted))


def _covariates(c: SurveyColumns, levels) -> list[Term]:
    return [
        factor("sex", c.sex, levels),
        Factor("race", F.col("race"), RACE_LEVELS),
        Number("age", F.col(c.age)),
        factor("area", c.area, levels),
        Factor("region", F.col("region"), tuple(REGIONS.values())),
        Number("residents", F.col(c.residents)),
        Number("income_pc", F.col("pc_last")),
        Number("parent_max", F.col("parent_max")),
    ]


def survival_study(
    waves: DataFrame, numbers: Sequence[int], c: SurveyColumns = SURVEY, lonely_psu: str = "fail"
) -> dict[str, DataFrame]:
    """Drop-out over consecutive waves: survival table, curves, and Cox and probit models of three populations.

    `waves` has all waves with their `wave` number. Curves and Cox models are unweighted.
    """
    first = numbers[0]
    cohort = audience.first_visit(F.col(c.visit)) & _attends(c) & in_course(c)
    table = panel.survival_table(_valid_waves(waves, c), "person_id", "wave", numbers, cohort, _has_left(c))
    people = _baseline_with_outcome(waves, table, c, first, cohort)
    spark = waves.sparkSession
    out: dict[str, DataFrame] = {}
    with staged(_model_columns(people, c, "status", "time", c.grade)) as rows:
        domains = quarterly_domains(c)
        populations = {"cohort": F.lit(True), **domains}
        levels = observed_levels(rows, [c.sex, c.area, c.grade])
        covariates = _covariates(c, levels)
        cox = []
        design = survey_design(rows, c, lonely_psu=lonely_psu)
        for name, inside in populations.items():
            fit = fit_cox(rows, [*covariates, factor("grade", c.grade, levels)], domain=inside, plain_scan=True)
            cox.append(fit.table(spark, name))
        fits = fit_probits(design, F.col("status"), covariates, populations, plain_scan=True)
        probit = [fit.table(spark, name) for name, fit in fits.items()]
        overall = km_curve(rows)
        curves = overall.unionByName(km_curve(rows, stratum=F.col(c.grade), populations=populations))
        # The curves must not depend on the staged table after it is gone.
        out["curves"] = checkpointed(curves)
    out["survival"] = table
    out["cox"] = _union(cox)
    out["probit"] = _union(probit)
    return out


def dropout_study(
    waves: DataFrame, numbers: Sequence[int], c: SurveyColumns = SURVEY, se: str | None = "taylor", lonely_psu: str = "fail"
) -> DataFrame:
    """Weighted counts and shares of drop-outs for every pair of consecutive waves.

    Each earlier wave is its own survey of first visits; drop-outs are a sub-population of it.
    """
    visited = audience.first_visit(F.col(c.visit))
    pairs = panel.pair_dropouts(
        waves.withColumn("person_id", person_key(c)),
        "person_id",
        "wave",
        numbers,
        visited & audience.birth_year_known(F.col(c.birth[2])),
        _attends(c),
        _has_left(c),
    )
    earlier = with_household_profile(waves.where(F.col("wave").isin(*numbers[:-1])), c, annual=False, by=["wave"])
    rows = attach_groups(_valid_waves(earlier, c).where(visited), pairs.withColumn("dropped", F.lit(True)), ["person_id", "wave"])
    gone = audience.flag(F.col("dropped"))
    domains = {"first_visit": F.lit(True), "attending": _attends(c), "dropout": gone}
    domains |= {f"dropout_{name}": gone & inside for name, inside in quarterly_domains(c).items()}
    wanted = Statistics(
        population=True, totals_by={"course": F.col(c.course)}, shares={"grade": F.col(c.grade)}
    )
    return estimates(survey_design(rows, c, by=["wave"], lonely_psu=lonely_psu), wanted, domains, se)


def evasion_study(
    waves: DataFrame, pair: tuple[int, int], c: SurveyColumns = SURVEY, lonely_psu: str = "fail"
) -> dict[str, DataFrame]:
    """Year-over-year evasion flags and their probit in three populations."""
    in_scope = in_course(c) & audience.grade_in(F.col(c.grade), GRADES)
    baseline = audience.first_visit(F.col(c.visit)) & in_scope
    flags = panel.evasion_flags(
        _valid_waves(waves, c),
        "person_id",
        "wave",
        pair,
        baseline=baseline,
        follow_up=audience.grade_in(F.col(c.grade), GRADES, or_missing=True),
        attends=_attends(c),
        left=_has_left(c),
        last_grade=F.col(c.grade) == GRADES[-1],
        grade_missing=F.col(c.grade).isNull(),
    )
    # Household income comes from first visits only, as the published analysis filters before summing.
    visits = waves.where(audience.first_visit(F.col(c.visit)) & audience.birth_year_known(F.col(c.birth[2])))
    people = _baseline_with_outcome(visits, flags, c, pair[0], in_scope)
    spark = waves.sparkSession
    with staged(_model_columns(people, c, "evaded")) as rows:
        levels = observed_levels(rows, [c.sex, c.area])
        design = survey_design(rows, c, lonely_psu=lonely_psu)
        populations = {"cohort": F.lit(True), **quarterly_domains(c)}
        fits = fit_probits(design, F.col("evaded"), _covariates(c, levels), populations, plain_scan=True)
        tables = [fit.table(spark, name) for name, fit in fits.items()]
    return {"evasion": flags, "probit": _union(tables)}


def characterisation_study(
    annual: DataFrame, c: SurveyColumns = SURVEY, se: str | None = None, lonely_psu: str = "fail"
) -> DataFrame:
    """All totals, shares and means of the three sub-populations for every year, in one pass."""
    rows = with_household_profile(annual, c, annual=True, by=["year"])
    categories = [c.sex, c.race, c.area, c.household_type, c.works, *c.goods, *c.dwelling_traits]
    attendance = [c.attends, c.course, c.network]
    wanted = Statistics(
        population=True,
        shares={**{name: F.col(name) for name in categories}, "region": F.col("region")},
        means={"income_pc": F.col("pc_last"), "parent_max": F.col("parent_max")},
        interactions={"attendance_course": attendance[:2], "attendance_course_network": attendance},
        levels=observed_levels(annual, attendance),
    )
    return estimates(survey_design(rows, c, by=["year"], lonely_psu=lonely_psu), wanted, annual_domains(c), se)


def characterisation_reports(
    results: DataFrame, regions: DataFrame, region_name: str, year: int, latest: int, c: SurveyColumns = SURVEY
) -> dict[str, DataFrame]:
    """The report tables: totals, demographics, dwelling, attendance, household types and regions."""
    demographics = [
        report.Block("By sex", c.sex),
        report.Block("By race", c.race),
        report.Block("Town or country", c.area),
        report.mean_block("Household income per head (mean)", "income_pc"),
    ]
    material, roof, floor, water, piped, dwelling = c.dwelling_traits
    dwelling_blocks = [
        report.Block("Has a car", c.goods[0]),
        report.Block("Walls", material),
        report.Block("Roof", roof),
        report.Block("Floor", floor),
        report.Block("Where water comes from", water),
        report.Block("Running water", piped),
        report.Block("Kind of dwelling", dwelling),
        report.mean_block("Schooling of the better educated parent (mean)", "parent_max"),
    ]
    attendance = [
        report.Block("At school, by course", "attendance_course"),
        report.Block("At school, by course and network", "attendance_course_network"),
    ]
    in_year, in_latest = F.col("year") == year, F.col("year") == latest
    two = {name: SUBPOPS[name] for name in ("target", "public_school")}
    potential = {"potential": SUBPOPS["potential"]}
    return {
        "totals": report.totals_report(results, SUBPOPS),
        "demographics": report.blocks_report(results, demographics, SUBPOPS, in_year),
        "dwelling": report.blocks_report(results, dwelling_blocks, two, in_year),
        "attendance": report.blocks_report(results, attendance, potential, in_latest, positive_only=True),
        "household_types": report.shares_report(
            results, c.household_type, "potential", in_latest, SUBPOPS["potential"]
        ),
        "regions": report.regions_report(results, "region", in_year, regions, region_name),
    }


def wage_study(annual: DataFrame, seed: int, c: SurveyColumns = SURVEY, lonely_psu: str = "fail") -> dict[str, DataFrame]:
    """Wage regression, wages imputed for the potential group, its regression, and the selection model."""
    spark = annual.sparkSession
    wages = annual.withColumn("person_id", person_key(c)).withColumns(
        {
            "hourly": hourly_wage(c.wage, c.hours),
            "employed": is_employed(c.wage),
        }
    )
    wages = with_household_profile(wages.withColumn("log_hourly", log_or_zero("hourly")), c, annual=True)
    columns = ("person_id", "log_hourly", "employed", c.schooling, c.relation, c.sector)
    with staged(_model_columns(wages, c, *columns)) as rows:
        levels = observed_levels(rows, [c.schooling, c.sex, c.area, c.relation])
        design = survey_design(rows, c, lonely_psu=lonely_psu)
        region = Factor("region", F.col("region"), tuple(REGIONS.values()))
        race = Factor("race", F.col("race"), RACE_LEVELS)
        sex, schooling = factor("sex", c.sex, levels), factor("schooling", c.schooling, levels)
        terms = [schooling, sex, race, factor("area", c.area, levels), Number("residents", F.col(c.residents)), region]
        age, sector = F.col(c.age), F.col(c.sector)

        working = audience.wage_sample(age, sector, PUBLIC_SECTOR)
        outcome = missing_as_zero("log_hourly")
        mincer = fit_linear(design, outcome, terms, working, plain_scan=True)

        potential = quarterly_domains(c)["potential"]
        donors = design.data.where(working).select("person_id", residuals(mincer, outcome).alias("residual"))
        targets = design.data.where(potential)
        person = ["person_id"]
        imputed = impute_outcome(targets, person, mincer, donors, person, "residual", seed, "log_hourly_imputed")
        imputed = imputed.withColumn("hourly_imputed", F.exp("log_hourly_imputed"))
        # Clusters without a potential person still count: the other rows stay, without an outcome.
        others = design.data.where(~audience.flag(potential))
        whole = replace(design, data=imputed.unionByName(others, allowMissingColumns=True))
        mincer_potential = fit_linear(whole, F.col("log_hourly_imputed"), terms, potential)

        two_step = heckman_two_step(
            design,
            selected=F.col("employed"),
            selection_terms=[Number("age", age), sex, race, factor("relation", c.relation, levels)],
            outcome=F.col("log_hourly"),
            outcome_terms=[schooling, Number("age", age), Number("age2", age * age), *terms[1:]],
            domain=audience.selection_sample(age, sector, PUBLIC_SECTOR),
            plain_scan=True,
        )
        fits = {"mincer": mincer, "mincer_potential": mincer_potential}
        fits |= {"selection": two_step.selection, "outcome": two_step.outcome}
        tables = {name: fit.table(spark, name) for name, fit in fits.items()}
    return {
        **tables,
        "mincer_table": report.coefficients_report(
            [tables["mincer"], tables["mincer_potential"]], ["mincer", "mincer_potential"]
        ),
        "heckman_table": report.coefficients_report([tables["selection"], tables["outcome"]], ["selection", "outcome"]),
    }


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
