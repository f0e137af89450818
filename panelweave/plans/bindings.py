"""How the given tables play the roles of a household survey.

The tables hold no NULL, so the bindings make some: `FIXTURES.md` section 3 explains the choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import audience
from panelweave.operators.design import SurveyDesign
from panelweave.operators.household import IncomeRoles, IncomeSource, ParentRoles
from panelweave.operators.model import Factor, Number

EXCLUDED_RELATIONS = ("R",)
INCOME_LIMIT = 30000.0
PERSON_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
ROW_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
WAVES = (1, 2, 3, 4, 5, 6, 7)
PANEL_ORDER = ("o_orderdate", "o_orderkey")
TOTALS = {"A": 120000.0, "N": 230000.0, "R": 120000.0}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REGION_NAMES = {"1": "Norte", "2": "Nordeste", "3": "Sudeste", "4": "Sul", "5": "Centro-Oeste"}
REPLICATES = 8
BOOTSTRAP, BOOTSTRAP_SEED = 200, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- households ----------------------------------------------------------------------------------

def relation() -> Column:
    return F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END")


def work_income() -> Column:
    return F.expr("CASE WHEN l_quantity <= 5 THEN NULL ELSE l_extendedprice END")


def other_income() -> Column:
    return F.expr("CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice * l_discount END")


def work_deflator() -> Column:
    return F.expr("sqrt(2 + l_tax)")


def other_deflator() -> Column:
    return F.expr("sqrt(3 + l_tax)")


def quarterly_income() -> IncomeRoles:
    return IncomeRoles(relation(), EXCLUDED_RELATIONS, [IncomeSource(work_income(), work_deflator(), work_deflator())])


def annual_income() -> IncomeRoles:
    sources = [
        IncomeSource(work_income(), work_deflator(), other_deflator()),
        IncomeSource(other_income(), other_deflator(), other_deflator()),
    ]
    return IncomeRoles(relation(), EXCLUDED_RELATIONS, sources)


def parent_roles() -> ParentRoles:
    return ParentRoles(
        sex_code=F.expr("CASE WHEN l_tax > 0.075 THEN NULL WHEN l_linestatus = 'F' THEN 2 ELSE 1 END"),
        relation_code=F.col("l_linenumber"),
        schooling_code=F.expr("nullif(cast(l_quantity AS int), 13)"),
        order=PERSON_ORDER,
    )


def audience_flags() -> dict[str, Column]:
    """Conditions on a frame that already has the annual household income."""
    age, pc = F.col("l_quantity"), F.col("pc_last")
    in_course = audience.equal_all([(F.expr("CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linestatus END"), "O")])
    alone = F.col("members") == 1
    benefits = [F.expr("CASE WHEN l_discount = 0 THEN NULL ELSE l_discount >= 0.09 END"), F.col("l_tax") > 0.075]
    schooling = F.expr("CASE WHEN l_linenumber = 6 THEN 'started' WHEN l_linestatus = 'O' THEN 'completed' END")
    sector, levels = F.expr("nullif(l_returnflag, 'N')"), ("completed", "started")
    return {
        "target_quarterly": audience.target_quarterly(age, in_course, pc, alone, income_limit=INCOME_LIMIT),
        "potential_quarterly": audience.potential_quarterly(age, pc, schooling, levels, income_limit=INCOME_LIMIT),
        "target_annual": audience.target_annual(age, in_course, pc, benefits, alone, income_limit=INCOME_LIMIT),
        "potential_annual": audience.potential_annual(age, pc, benefits, schooling, levels, income_limit=INCOME_LIMIT),
        "wage_sample": audience.wage_sample(age, sector, "A"),
        "selection_sample": audience.selection_sample(age, sector, "A"),
    }


# --- panel ---------------------------------------------------------------------------------------

def attends() -> Column:
    return F.col("o_orderstatus") == "F"


def has_left() -> Column:
    return F.col("o_orderstatus") == "P"


def grade() -> Column:
    return F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE substring(o_orderpriority, 1, 1) END")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as person-waves: a customer may have several orders in a wave, of which the last counts."""
    orders = table(spark, sf_dir, "orders")
    first, last = 1994 + WAVES[0], 1995 + WAVES[-1]
    in_waves = (F.col("o_orderdate") >= F.lit(f"{first}-01-01")) & (F.col("o_orderdate") < F.lit(f"{last}-01-01"))
    return orders.where(in_waves).withColumn("wave", F.year("o_orderdate") - 1994)


MONTHS = tuple(range(1, 61))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as monthly waves of suppliers from 1995 on; several rows of a supplier in a month are the rule."""
    month = F.expr("(year(l_shipdate) - 1995) * 12 + month(l_shipdate)")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_tax", month.alias("wave"))


def large_shipment() -> Column:
    return F.col("l_quantity") > 10


# --- sample design -------------------------------------------------------------------------------

def domains() -> dict[str, Column]:
    return {
        "target": F.expr("l_quantity BETWEEN 14 AND 24 AND l_linestatus = 'O'"),
        "potential": F.expr("l_discount >= 0.09"),
        "public": F.expr("nullif(l_returnflag, 'N') = 'A'"),
    }


def flag() -> Column:
    return F.col("l_returnflag")


def status() -> Column:
    return F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END")


def price() -> Column:
    return work_income()


def design(spark: SparkSession, sf_dir: str, by_year: bool = False) -> SurveyDesign:
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"w": F.expr("1 + l_quantity / 10"), "psu": F.expr("l_suppkey % 10")}
    )
    if by_year:
        rows = rows.withColumn("year", F.year("l_shipdate"))
    return SurveyDesign(rows, "w", "l_linenumber", "psu", by=("year",) if by_year else ())


def replicate_weights() -> dict[str, Column]:
    return {
        f"w{r}": F.expr(f"w * (1 + ((l_orderkey * {r + 1}) % 7 - 3) / 10.0D)") for r in range(1, REPLICATES + 1)
    }


# --- models --------------------------------------------------------------------------------------

def flag_factor() -> Factor:
    return Factor("flag", flag(), ("A", "N", "R"))


def status_factor() -> Factor:
    return Factor("status", F.col("l_linestatus"), ("F", "O"))


PART_LEVELS = 2000


def part_factor() -> Factor:
    return Factor("part", F.col("l_partkey") % PART_LEVELS, [str(k) for k in range(PART_LEVELS)])


def quantity() -> Number:
    return Number("quantity", F.col("l_quantity"))


def log_price() -> Column:
    return F.ln("l_extendedprice")


def order_design(spark: SparkSession, sf_dir: str) -> SurveyDesign:
    rows = table(spark, sf_dir, "orders").withColumns(
        {"w": F.expr("1 + o_custkey % 7"), "psu": F.expr("o_custkey % 20")}
    )
    return SurveyDesign(rows, "w", "o_orderpriority", "psu")
