"""Column names, labels and shared preparation of the household survey."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import recode, region_from_key, text_key
from panelweave.operators import audience
from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.household import IncomeRoles, IncomeSource, ParentRoles, household_profile
from panelweave.operators.model import Factor

# Labels of the survey's categories.
YES, NO = "Sim", "Não"
PUBLIC_NETWORK = "Rede pública"
REGULAR_COURSE = "Regular do ensino médio"
ONE_PERSON = "Unipessoal"
SCHOOLING_COMPLETED = "Fundamental completo ou equivalente"
SCHOOLING_STARTED = "Médio incompleto ou equivalente"
PUBLIC_SECTOR = "Empregado no setor público (inclusive servidor estatutário e militar)"
EXCLUDED_RELATIONS = ("Pensionista", "Empregado(a) doméstico(a)", "Parente do(a) empregado(a) doméstico(a)")
GRADES = ("Primeira (o)", "Segunda (o)", "Terceira (o)")
REGIONS = {"1": "Norte", "2": "Nordeste", "3": "Sudeste", "4": "Sul", "5": "Centro-Oeste"}
RACE = {
    "Branca": "Branca",
    "Preta": "Preta ou Parda",
    "Amarela": "Amarela",
    "Parda": "Preta ou Parda",
    "Indígena": "Indígena",
    "Ignorado": "Ignorado",
}
RACE_LEVELS = ("Branca", "Preta ou Parda", "Amarela", "Indígena", "Ignorado")


@dataclass(frozen=True)
class SurveyColumns:
    """Names of the survey's columns. `<name>_code` holds the level code next to a label."""

    cluster: str = "UPA"
    dwelling: str = "V1008"
    panel_group: str = "V1014"
    visit: str = "V1016"
    area: str = "V1022"
    residents: str = "V2001"
    position: str = "V2003"
    relation: str = "V2005"
    sex: str = "V2007"
    birth: tuple[str, str, str] = ("V2008", "V20081", "V20082")
    age: str = "V2009"
    race: str = "V2010"
    household_position: str = "VD2002"
    household_type: str = "VD2004"
    schooling_level: str = "VD3004"
    schooling: str = "VD3005"
    attends: str = "V3002"
    network: str = "V3002A"
    course: str = "V3003A"
    grade: str = "V3006"
    quarterly_income: str = "VD4020"
    quarterly_deflator: str = "Efetivo"
    work_income: str = "VD4019"
    other_income: str = "VD4048"
    work_deflators: tuple[str, str] = ("CO1", "CO2")
    other_deflators: tuple[str, str] = ("CO1e", "CO2e")
    wage: str = "VD4017"
    hours: str = "V4039"
    sector: str = "VD4008"
    works: str = "V4003"
    benefits: tuple[str, ...] = ("V5001A", "V5002A", "V5003A")
    goods: tuple[str, ...] = ("S010311", "S01028", "S01024")
    dwelling_traits: tuple[str, ...] = ("S01002", "S01003", "S01004", "S01007", "S01010", "S01017")
    strata: str = "stratum"
    psu: str = "UPA"
    weight: str = "weight"
    poststratum: str | None = None
    poststratum_total: str | None = None


SURVEY = SurveyColumns()


def person_key(c: SurveyColumns) -> Column:
    return text_key(c.cluster, c.dwelling, c.panel_group, c.position, *c.birth, sep="_")


def with_household_profile(rows: DataFrame, c: SurveyColumns, annual: bool, by: Sequence[str] = ()) -> DataFrame:
    """Household key, region, merged race, real income per head and parents' schooling on every person."""
    if annual:
        sources = [
            IncomeSource(F.col(c.work_income), *[F.col(d) for d in c.work_deflators]),
            IncomeSource(F.col(c.other_income), *[F.col(d) for d in c.other_deflators]),
        ]
    else:
        deflator = F.col(c.quarterly_deflator)
        sources = [IncomeSource(F.col(c.quarterly_income), deflator, deflator)]
    income = IncomeRoles(F.col(c.relation), EXCLUDED_RELATIONS, sources)
    parents = ParentRoles(
        F.col(f"{c.sex}_code"), F.col(f"{c.household_position}_code"), F.col(f"{c.schooling}_code"), [c.position]
    )
    keyed = rows.withColumns(
        {
            "household_id": text_key(c.cluster, c.dwelling, c.panel_group),
            "region": region_from_key(c.cluster, REGIONS),
            "race": recode(c.race, RACE),
        }
    )
    return household_profile(keyed, [*by, "household_id"], income=income, parents=parents)


def survey_design(rows: DataFrame, c: SurveyColumns, by: Sequence[str] = (), lonely_psu: str = "fail") -> SurveyDesign:
    """The design of the given rows; post-stratified when the survey names its post-strata."""
    design = SurveyDesign(rows, c.weight, c.strata, c.psu, by=tuple(by), lonely_psu=lonely_psu)
    if c.poststratum and c.poststratum_total:
        return poststratify(design, c.poststratum, c.poststratum_total)
    return design


def in_course(c: SurveyColumns) -> Column:
    return audience.equal_all([(F.col(c.course), REGULAR_COURSE), (F.col(c.network), PUBLIC_NETWORK)])


def quarterly_domains(c: SurveyColumns, income: str = "pc_last") -> dict[str, Column]:
    alone = F.col(c.household_type) == ONE_PERSON
    levels = (SCHOOLING_COMPLETED, SCHOOLING_STARTED)
    return {
        "target": audience.target_quarterly(F.col(c.age), in_course(c), F.col(income), alone),
        "potential": audience.potential_quarterly(F.col(c.age), F.col(income), F.col(c.schooling_level), levels),
    }


def annual_domains(c: SurveyColumns, income: str = "pc_last") -> dict[str, Column]:
    alone = F.col(c.household_type) == ONE_PERSON
    benefits = [F.col(name) == YES for name in c.benefits]
    levels = (SCHOOLING_COMPLETED, SCHOOLING_STARTED)
    return {
        "target": audience.target_annual(F.col(c.age), in_course(c), F.col(income), benefits, alone),
        "potential": audience.potential_annual(F.col(c.age), F.col(income), benefits, F.col(c.schooling_level), levels),
        "public_school": F.col(c.network) == PUBLIC_NETWORK,
    }


def observed_levels(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Distinct labels of several categorical columns, in one job; by level code where there is one.

    The labels become terms of a model or lines of a report, so the driver holds one entry for each.
    """
    pairs = []
    for name in columns:
        code = F.col(f"{name}_code").cast("int") if f"{name}_code" in rows.columns else F.lit(0)
        pairs.append(F.struct(code.alias("code"), F.col(name).cast("string").alias("label")).alias(name))
    long = rows.select(*pairs).unpivot([], list(columns), "name", "level").select("name", "level.*")
    found = long.where(F.col("label").isNotNull()).distinct().collect()
    ordered = sorted(found, key=lambda r: (r["code"], r["label"]))
    return {name: tuple(dict.fromkeys(r["label"] for r in ordered if r["name"] == name)) for name in columns}


def factor(name: str, column: str, levels: Mapping[str, Sequence[str]]) -> Factor:
    return Factor(name, F.col(column), levels[column])
