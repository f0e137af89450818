"""One query per operator over the given tables. Doubles are rounded so that two engines can agree."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions import scalars
from panelweave.operators import audience, panel, report, survival
from panelweave.operators import household as hh
from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.estimate import (
    Statistics,
    additive_sums,
    estimates,
    estimates_from_sums,
    svy_interaction,
    svy_mean,
    svy_share,
    svy_total,
    svy_total_by,
)
from panelweave.operators.glm import fit_linear, fit_probit, fit_probits, residuals
from panelweave.operators.model import Factor, Layout, Number
from panelweave.operators.selection import heckman_two_step, impute_outcome
from panelweave.operators.skew import lookup_join
from panelweave.plans import bindings as b
from panelweave.plans import studies, survey_view
from panelweave.session import shared_folder
from panelweave.sources import estimates as saved
from panelweave.sources import microdata


def _rounded(frame: DataFrame, digits: dict[str, int]) -> DataFrame:
    return frame.withColumns({name: F.round(name, d) for name, d in digits.items()})


def _scratch(spark: SparkSession, name: str) -> str:
    # The shared folder goes when the application ends, and with it what queries have landed there.
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- households and people -----------------------------------------------------------------------


def household_income(spark, sf_dir):
    people = hh.household_income(b.table(spark, sf_dir, "lineitem"), "l_orderkey", b.quarterly_income())
    return _rounded(people.select(*b.ROW_KEYS, *hh.INCOME_COLUMNS), dict.fromkeys(hh.INCOME_COLUMNS, 4))


def household_income_annual(spark, sf_dir):
    people = hh.household_income(b.table(spark, sf_dir, "lineitem"), "l_orderkey", b.annual_income())
    return _rounded(people.select(*b.ROW_KEYS, *hh.INCOME_COLUMNS), dict.fromkeys(hh.INCOME_COLUMNS, 3))


def parent_max(spark, sf_dir):
    people = hh.parents_schooling(b.table(spark, sf_dir, "lineitem"), "l_orderkey", b.parent_roles())
    return people.select(*b.ROW_KEYS, *hh.PARENT_COLUMNS)


def region_recode(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem")
    region = scalars.region_from_key("l_partkey", b.REGION_NAMES)
    return rows.groupBy(region.alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def category_recode(spark, sf_dir):
    merged = {"SMALL": "SMALL", "MEDIUM": "MEDIUM OR LARGE", "LARGE": "MEDIUM OR LARGE", "ECONOMY": "ECONOMY"}
    rows = b.table(spark, sf_dir, "part")
    return rows.select("p_partkey", scalars.recode("p_type", merged).alias("category"))


def person_key(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders")
    status = F.expr("nullif(o_orderstatus, 'P')")
    return rows.select(
        "o_orderkey",
        scalars.text_key("o_custkey", status, F.year("o_orderdate")).alias("household_id"),
        scalars.text_key("o_custkey", status, "o_orderkey", sep="_").alias("person_id"),
    )


def audience_flags(spark, sf_dir):
    people = hh.household_income(b.table(spark, sf_dir, "lineitem"), "l_orderkey", b.annual_income())
    flags = {name: audience.flag(c).cast("int") for name, c in b.audience_flags().items()}
    return people.select(*b.ROW_KEYS, *[c.alias(name) for name, c in flags.items()])


def hourly_wage(spark, sf_dir):
    wage = F.expr("CASE WHEN l_quantity <= 5 THEN NULL WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END")
    rows = b.table(spark, sf_dir, "lineitem").select(
        *b.ROW_KEYS, wage.alias("wage"), F.expr("nullif(l_quantity, 10) * l_discount").alias("hours")
    )
    hourly = rows.withColumn("hourly", scalars.hourly_wage("wage", "hours"))
    return hourly.select(
        *b.ROW_KEYS,
        F.round("hourly", 6).alias("hourly"),
        F.round(scalars.log_or_zero("hourly"), 8).alias("log_hourly"),
        F.round(scalars.missing_as_zero(scalars.log_or_zero("hourly")), 8).alias("log_hourly_or_zero"),
        scalars.is_employed("wage").alias("employed"),
    )


# --- sources -------------------------------------------------------------------------------------


def deflator_join(spark, sf_dir):
    deflators = b.table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(
        F.col("n_nationkey").alias("c_nationkey"), F.expr("1 + n_nationkey / 100").alias("deflator")
    )
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    joined = microdata.attach_deflators(rows, deflators, ["c_nationkey"])
    return joined.select("c_custkey", "deflator", F.round(F.col("c_acctbal") * F.col("deflator"), 4).alias("real"))


def label_decode(spark, sf_dir):
    dictionary = b.table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(
        F.lit("nation").alias("var"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label")
    )
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return microdata.decode_labels(rows, dictionary, ["nation"])


def quarterly_waves(spark, sf_dir):
    """Land the orders by (year, quarter), then read the four quarters of 1997 and the first of 1998."""
    orders = b.table(spark, sf_dir, "orders").withColumns(
        {"year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate")}
    )
    path = _scratch(spark, "quarters")
    microdata.write_microdata(orders.hint("rebalance"), path, ["year", "quarter"])
    waves = microdata.read_quarters(spark, path, {1997: (1, 2, 3, 4), 1998: (1,)}, ["o_orderkey", "o_totalprice"])
    return waves.groupBy("wave", "year", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def annual_files(spark, sf_dir):
    """Land the orders by (year, visit), then read the first visit of three years."""
    orders = b.table(spark, sf_dir, "orders").withColumns(
        {"year": F.year("o_orderdate"), "visit": F.expr("substring(o_orderpriority, 1, 1)").cast("int")}
    )
    path = _scratch(spark, "years")
    microdata.write_microdata(orders.hint("rebalance"), path, ["year", "visit"])
    rows = microdata.read_annual(spark, path, (1996, 1997, 1999), 1, ["o_orderkey", "o_totalprice"])
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def fixed_width_read(spark, sf_dir):
    """Land the orders as fixed-width records, then read them by layout."""
    orders = b.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.format_string("%12.2f", "o_totalprice")).otherwise(F.lit(" " * 12))
    record = F.concat(
        F.format_string("%10d", "o_orderkey"), F.format_string("%8d", "o_custkey"), "o_orderstatus", price
    )
    path = _scratch(spark, "records")
    orders.select(record.alias("value")).write.text(path)
    layout = [
        microdata.FixedField("o_orderkey", 1, 10, "bigint"),
        microdata.FixedField("o_custkey", 11, 8, "bigint"),
        microdata.FixedField("o_orderstatus", 19, 1),
        microdata.FixedField("o_totalprice", 20, 12, "double"),
    ]
    return microdata.read_fixed_width(spark, path, layout)


RAW_QUARTERS = ((1996, 3), (1996, 4), (1997, 1), (1997, 2))
RAW_LAYOUT = (
    microdata.FixedField("o_orderkey", 1, 10, "bigint"),
    microdata.FixedField("o_orderstatus", 11, 1),
    microdata.FixedField("o_totalprice", 12, 12, "double"),
)


def _raw_quarters(spark, sf_dir) -> microdata.RawRecords:
    """Orders landed as one folder of records per quarter, some of them broken; the first quarter isn't asked for."""
    price = F.format_string("%12.2f", "o_totalprice")
    broken = F.when(F.col("o_orderkey") % 25 == 1, F.lit("      12,5x ")).when(F.col("o_orderkey") % 25 == 2, " " * 12)
    record = F.concat(F.format_string("%10d", "o_orderkey"), "o_orderstatus", F.coalesce(broken, price))
    torn = F.when(F.col("o_orderkey") % 25 == 3, F.substring(record, 1, 15)).when(F.col("o_orderkey") % 25 == 4, F.concat(record, F.lit("7")))
    path = _scratch(spark, "raw")
    for year, quarter in ((1996, 2), *RAW_QUARTERS):
        rows = b.table(spark, sf_dir, "orders").where((F.year("o_orderdate") == year) & (F.quarter("o_orderdate") == quarter))
        rows.select(F.coalesce(torn, record).alias("value")).write.text(f"{path}/people_{quarter:02d}{year}")
    pattern = r"people_(?P<quarter>\d{2})(?P<year>\d{4})"
    return microdata.read_raw_periods(spark, f"{path}/*", RAW_LAYOUT, pattern, periods=RAW_QUARTERS)


def raw_quarters(spark, sf_dir):
    return _rounded(_raw_quarters(spark, sf_dir).good, {"o_totalprice": 2})


def raw_quarter_counts(spark, sf_dir):
    return _raw_quarters(spark, sf_dir).counts()


# --- panel ---------------------------------------------------------------------------------------


def baseline_cohort(spark, sf_dir):
    conditions = [
        audience.birth_year_known(F.col("o_custkey") % 100, unknown=99),
        audience.first_visit(F.substring("o_orderpriority", 1, 1)) | audience.grade_in(b.grade(), ("2", "3"), or_missing=True),
        b.attends(),
    ]
    return panel.baseline_cohort(b.panel(spark, sf_dir), "wave", 1, conditions).select("o_orderkey", "o_custkey")


def _pair_dropouts(spark, sf_dir):
    return panel.pair_dropouts(
        b.panel(spark, sf_dir), "o_custkey", "wave", b.WAVES, b.grade().isNotNull(), b.attends(), b.has_left(), b.PANEL_ORDER
    )


def pair_dropout(spark, sf_dir):
    return _pair_dropouts(spark, sf_dir)


def dropout_semi(spark, sf_dir):
    rows = b.panel(spark, sf_dir).select("o_orderkey", "o_custkey", "wave", "o_orderstatus")
    return panel.rows_of(rows, _pair_dropouts(spark, sf_dir), ["o_custkey", "wave"])


def attrition_anti(spark, sf_dir):
    return panel.attrition(b.panel(spark, sf_dir), "o_custkey", "wave", (1, 2), b.attends(), b.PANEL_ORDER)


def _survival(spark, sf_dir):
    return panel.survival_table(
        b.panel(spark, sf_dir), "o_custkey", "wave", b.WAVES, b.attends(), b.has_left(), b.PANEL_ORDER
    )


def survival_table(spark, sf_dir):
    return _survival(spark, sf_dir)


def monthly_survival(spark, sf_dir):
    """Sixty waves: who had a small shipment in the first month, until a month has none or only large ones."""
    large = b.large_shipment()
    return panel.survival_table(b.monthly_panel(spark, sf_dir), "l_suppkey", "wave", b.MONTHS, ~large, large)


def monthly_dropout(spark, sf_dir):
    large = b.large_shipment()
    return panel.pair_dropouts(
        b.monthly_panel(spark, sf_dir), "l_suppkey", "wave", b.MONTHS, eligible=F.col("l_tax") > 0.02, attends=~large, left=large
    )


def matched_waves(spark, sf_dir):
    status = F.when(b.attends(), panel.ATTENDS).when(b.has_left(), panel.LEFT)
    return panel.matched_waves(
        b.panel(spark, sf_dir), "o_custkey", "wave", (1, 2), {"state": status, "price": F.col("o_totalprice")}, b.PANEL_ORDER
    )


def _evasion(spark, sf_dir):
    return panel.evasion_flags(
        b.panel(spark, sf_dir),
        "o_custkey",
        "wave",
        (1, 2),
        baseline=audience.grade_in(b.grade(), ("1", "2", "3")),
        follow_up=audience.grade_in(b.grade(), ("1", "2", "3"), or_missing=True),
        attends=b.attends(),
        left=b.has_left(),
        last_grade=b.grade() == "3",
        grade_missing=b.grade().isNull(),
        order=b.PANEL_ORDER,
    )


def evasion_flag(spark, sf_dir):
    return _evasion(spark, sf_dir)


def _covariates(spark, sf_dir):
    merged = {"AUTOMOBILE": "AUTOMOBILE", "MACHINERY": "MACHINERY", "FURNITURE": "HOME", "HOUSEHOLD": "HOME"}
    return b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_mktsegment").alias("segment"),
        scalars.recode("c_mktsegment", merged).alias("group"),
        F.col("c_acctbal").alias("balance"),
    )


def cohort_covariates(spark, sf_dir):
    return panel.with_covariates(_survival(spark, sf_dir), _covariates(spark, sf_dir), "o_custkey")


# --- estimates -----------------------------------------------------------------------------------

ESTIMATE_DIGITS = {"value": 6}
LEVELS = {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O", "Z")}


def svy_total_query(spark, sf_dir):
    return _rounded(svy_total(b.design(spark, sf_dir), b.domains()), ESTIMATE_DIGITS)


def svy_total_by_query(spark, sf_dir):
    return _rounded(svy_total_by(b.design(spark, sf_dir), {"status": b.status()}, b.domains()), ESTIMATE_DIGITS)


def svy_share_query(spark, sf_dir):
    return _rounded(svy_share(b.design(spark, sf_dir), {"flag": b.flag(), "status": b.status()}, b.domains()), ESTIMATE_DIGITS)


def svy_mean_query(spark, sf_dir):
    return _rounded(svy_mean(b.design(spark, sf_dir), {"price": b.price()}, b.domains()), {"value": 4})


def svy_interaction_query(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus"]
    return _rounded(svy_interaction(b.design(spark, sf_dir), "flag_status", columns, LEVELS, b.domains()), ESTIMATE_DIGITS)


def batch() -> Statistics:
    return Statistics(
        population=True,
        totals_by={"flag": b.flag()},
        shares={"flag": b.flag(), "status": b.status(), "line": F.col("l_linenumber")},
        means={"price": b.price(), "discount": F.col("l_discount")},
    )



def svy_batch(spark, sf_dir):
    return _rounded(estimates(b.design(spark, sf_dir, by_year=True), batch(), b.domains()), {"value": 4})


def svy_poststratify(spark, sf_dir):
    adjusted = poststratify(b.design(spark, sf_dir), "l_returnflag", b.TOTALS)
    wanted = Statistics(population=True, totals_by={"flag": b.flag()}, shares={"status": b.status()})
    return _rounded(estimates(adjusted, wanted, {"all": F.lit(True), **b.domains()}), {"value": 4})


def _se_statistics() -> Statistics:
    return Statistics(population=True, shares={"flag": b.flag(), "status": b.status()}, means={"price": b.price()})



def svy_se_taylor(spark, sf_dir):
    return _rounded(estimates(b.design(spark, sf_dir), _se_statistics(), b.domains(), "taylor"), {"value": 4, "std_error": 4})


def svy_se_poststratified(spark, sf_dir):
    adjusted = poststratify(b.design(spark, sf_dir), "l_returnflag", b.TOTALS)
    return _rounded(estimates(adjusted, _se_statistics(), b.domains(), "taylor"), {"value": 4, "std_error": 4})


def svy_se_replicate(spark, sf_dir):
    weights = b.replicate_weights()
    design = replace(b.design(spark, sf_dir).with_columns(weights), replicates=tuple(weights))
    return _rounded(estimates(design, _se_statistics(), b.domains(), "replicate"), {"value": 4, "std_error": 4})


def svy_se_bootstrap(spark, sf_dir):
    design = replace(b.design(spark, sf_dir), bootstrap=b.BOOTSTRAP, seed=b.BOOTSTRAP_SEED)
    return _rounded(estimates(design, _se_statistics(), b.domains(), "bootstrap"), {"value": 4, "std_error": 4})


# --- survival and regression ---------------------------------------------------------------------

CURVE_DIGITS = dict.fromkeys(("surv", "std_error", "lower", "upper"), 8)


def km_curve(spark, sf_dir):
    return _rounded(survival.km_curve(_survival(spark, sf_dir)), CURVE_DIGITS)


def km_curve_by(spark, sf_dir):
    people = cohort_covariates(spark, sf_dir)
    populations = {"all": F.lit(True), "solvent": F.col("balance") > 0}
    return _rounded(survival.km_curve(people, stratum=F.col("group"), populations=populations), CURVE_DIGITS)


def cox_fit(spark, sf_dir):
    people = cohort_covariates(spark, sf_dir)
    terms = [Factor("segment", F.col("segment"), b.SEGMENTS), Number("balance", F.col("balance") / 1000)]
    table = survival.fit_cox(people, terms).table(spark, "cox").select(*FIT_COLUMNS)
    return _rounded(table, dict.fromkeys(FIT_COLUMNS[1:], 5))


def cox_one_binary(spark, sf_dir):
    people = cohort_covariates(spark, sf_dir)
    fit = survival.fit_cox(people, [Number("solvent", (F.col("balance") > 4000).cast("int"))])
    return _fit_rows(fit, spark, "cox", ("term", "estimate", "std_error"))


# The given tables are plain files: a fit reads its few columns again rather than write them first.
FIT_COLUMNS = ("term", "estimate", "std_error", "statistic")


def _one_factor(spark, sf_dir):
    return fit_linear(b.design(spark, sf_dir), b.log_price(), [b.flag_factor()], plain_scan=True)


def _one_number(spark, sf_dir):
    return fit_linear(b.design(spark, sf_dir), b.log_price(), [b.quantity()], plain_scan=True)


def _fit_rows(fit, spark, model, columns=FIT_COLUMNS):
    table = fit.table(spark, model).select(*columns)
    return _rounded(table, {c: 6 for c in columns if c != "term"})


def wls_one_factor(spark, sf_dir):
    return _fit_rows(_one_factor(spark, sf_dir), spark, "factor")


def wls_one_number(spark, sf_dir):
    return _fit_rows(_one_number(spark, sf_dir), spark, "number")


def wls_sandwich_se(spark, sf_dir):
    """A domain of a post-stratified design: the residual scores of all clusters matter."""
    adjusted = poststratify(b.design(spark, sf_dir), "l_returnflag", b.TOTALS)
    fit = fit_linear(adjusted, b.log_price(), [b.quantity()], domain=b.domains()["potential"])
    return _fit_rows(fit, spark, "domain")


def mincer_fit(spark, sf_dir):
    terms = [b.flag_factor(), b.status_factor(), b.quantity()]
    return _fit_rows(fit_linear(b.design(spark, sf_dir), b.log_price(), terms, plain_scan=True), spark, "linear")


def wls_many_levels(spark, sf_dir):
    """A factor of 2,000 levels next to a number."""
    fit = fit_linear(b.design(spark, sf_dir), b.log_price(), [b.part_factor(), b.quantity()], plain_scan=True)
    table = fit.table(spark, "parts").select("term", "estimate", "std_error", "converged")
    return _rounded(table, {"estimate": 6, "std_error": 6})


def wls_significance(spark, sf_dir):
    """Every column of a coefficient table, for a term without an effect."""
    fit = fit_linear(b.design(spark, sf_dir), b.log_price(), [Number("tax", F.col("l_tax"))], plain_scan=True)
    return _rounded(fit.table(spark, "tax"), dict.fromkeys(("estimate", "std_error", "statistic", "p_value"), 6))


def _has_left_number() -> Column:
    return b.has_left().cast("int")



def probit_fit(spark, sf_dir):
    terms = [Factor("priority", F.col("o_orderpriority"), b.PRIORITIES), Number("log_price", F.ln("o_totalprice"))]
    fit = fit_probit(b.order_design(spark, sf_dir), _has_left_number(), terms, plain_scan=True)
    return _rounded(fit.table(spark, "probit").select(*FIT_COLUMNS), dict.fromkeys(FIT_COLUMNS[1:], 5))


def probit_populations(spark, sf_dir):
    """Three sub-populations fitted in the same passes."""
    step = F.floor(F.col("o_totalprice") / 50000).cast("double")
    terms = [Factor("priority", F.col("o_orderpriority"), b.PRIORITIES), Number("step", step)]
    populations = {"all": F.lit(True), "cheap": F.col("o_totalprice") < 150000, "odd": F.col("o_custkey") % 2 == 1}
    fits = fit_probits(b.order_design(spark, sf_dir), _has_left_number(), terms, populations, plain_scan=True)
    table = reduce(DataFrame.unionByName, [fit.table(spark, name) for name, fit in fits.items()])
    return _rounded(table.select("model", "term", "estimate", "std_error", "converged"), {"estimate": 5, "std_error": 5})


def probit_one_factor(spark, sf_dir):
    terms = [Factor("priority", F.col("o_orderpriority"), b.PRIORITIES)]
    fit = fit_probit(b.order_design(spark, sf_dir), _has_left_number(), terms, plain_scan=True)
    return _fit_rows(fit, spark, "probit", ("term", "estimate", "std_error"))


def probit_one_number(spark, sf_dir):
    season = F.expr("CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) + month(o_orderdate) / 12")
    fit = fit_probit(b.order_design(spark, sf_dir), _has_left_number(), [Number("season", season)], plain_scan=True)
    return _fit_rows(fit, spark, "probit", ("term", "estimate", "std_error"))


def evasion_probit(spark, sf_dir):
    """Evasion flags with covariates, weighted: the year-over-year study end to end."""
    people = panel.with_covariates(_evasion(spark, sf_dir), _covariates(spark, sf_dir), "o_custkey")
    rows = people.withColumns({"w": F.expr("1 + o_custkey % 7"), "psu": F.expr("o_custkey % 20"), "h": F.expr("o_custkey % 3")})
    design = SurveyDesign(rows, "w", "h", "psu", lonely_psu="remove")
    terms = [Factor("group", F.col("group"), ("AUTOMOBILE", "MACHINERY", "HOME")), Number("balance", F.col("balance") / 1000)]
    fit = fit_probit(design, F.col("evaded"), terms)
    return _rounded(fit.table(spark, "evasion").select(*FIT_COLUMNS), dict.fromkeys(FIT_COLUMNS[1:], 5))


# --- selection and imputation --------------------------------------------------------------------

GIVEN_PROBIT = {"(Intercept)": -2.6, "flagN": 0.7, "flagR": -1.1, "quantity": 0.07}


def mills_ratio(spark, sf_dir):
    """Linear predictor of given coefficients and its inverse Mills ratio, NULL where a term is missing."""
    status = Factor("flag", F.expr("CASE WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END"), ("A", "N", "R"))
    z = Layout([status, b.quantity()]).predictor(GIVEN_PROBIT)
    rows = b.table(spark, sf_dir, "lineitem").withColumn("z", z)
    return rows.select(*b.ROW_KEYS, F.round("z", 8).alias("z"), F.round(scalars.inverse_mills("z"), 8).alias("mills"))


def residual_impute(spark, sf_dir):
    """Residuals of one group's fit drawn for another group, and the imputed outcome."""
    terms = [b.flag_factor(), b.status_factor(), b.quantity()]
    design = b.design(spark, sf_dir)
    fit = fit_linear(design, b.log_price(), terms, domain=F.col("l_quantity") >= 25)
    donors = design.data.where("l_quantity >= 25").select(*b.ROW_KEYS, residuals(fit, b.log_price()).alias("residual"))
    targets = design.data.where("l_quantity < 25")
    imputed = impute_outcome(targets, b.ROW_KEYS, fit, donors, b.ROW_KEYS, "residual", seed=7, outcome="log_imputed")
    return imputed.select(
        *b.ROW_KEYS,
        F.round("drawn_residual", 6).alias("drawn_residual"),
        F.round("log_imputed", 6).alias("log_imputed"),
        F.round(F.exp("log_imputed"), 2).alias("imputed"),
    )


def _outcome_terms():
    squared = Number("quantity2", F.col("l_quantity") * F.col("l_quantity"))
    return [b.flag_factor(), b.status_factor(), b.quantity(), squared]


def _two_step_rows(fit, spark):
    both = fit.selection.table(spark, "selection").unionByName(fit.outcome.table(spark, "outcome"))
    return _rounded(both.select("model", "term", "estimate", "std_error"), {"estimate": 5, "std_error": 5})


def heckman_two_step_query(spark, sf_dir):
    fit = heckman_two_step(
        b.design(spark, sf_dir),
        selected=(F.col("l_discount") > 0).cast("int"),
        selection_terms=[b.flag_factor(), Number("tax", F.col("l_tax"))],
        outcome=b.log_price(),
        outcome_terms=_outcome_terms(),
        plain_scan=True,
    )
    return _two_step_rows(fit, spark)


def heckman_one_number(spark, sf_dir):
    """The two steps with one number in the selection, where both have a counterpart in SQL."""
    fit = heckman_two_step(
        b.design(spark, sf_dir),
        selected=(F.col("l_discount") > 0).cast("int"),
        selection_terms=[Number("tax", F.col("l_tax"))],
        outcome=b.log_price(),
        outcome_terms=_outcome_terms(),
        plain_scan=True,
    )
    return _two_step_rows(fit, spark)


# --- studies -------------------------------------------------------------------------------------


def dropout_study(spark, sf_dir):
    """Weighted drop-out of every wave pair in five sub-populations, on the survey view of the tables."""
    waves = survey_view.waves(spark, sf_dir)
    return _rounded(studies.dropout_study(waves, b.WAVES, se=None, lonely_psu="remove"), ESTIMATE_DIGITS)


# --- reports -------------------------------------------------------------------------------------

SUBPOPS = {"target": "target_group", "potential": "potential_group", "public": "public_school"}
def _report_year() -> Column:
    return F.col("year") == 1997



def _report_estimates(spark, sf_dir, statistics=None):
    return estimates(b.design(spark, sf_dir, by_year=True), statistics or batch(), b.domains())


def report_totals(spark, sf_dir):
    wide = report.totals_report(_report_estimates(spark, sf_dir), SUBPOPS)
    return _rounded(wide, dict.fromkeys(SUBPOPS.values(), 4))


def report_blocks(spark, sf_dir):
    blocks = [report.Block("Flag", "flag"), report.Block("Status", "status"), report.mean_block("Income", "price")]
    rows = _report_estimates(spark, sf_dir)
    rows = rows.withColumn("value", F.when(F.col("stat") == "mean", F.bround("value", 2)).otherwise(F.col("value")))
    return report.blocks_report(rows, blocks, SUBPOPS, _report_year())


def report_shares(spark, sf_dir):
    statistics = Statistics(interactions={"flag_status": ["l_returnflag", "l_linestatus"]}, levels=LEVELS)
    rows = _report_estimates(spark, sf_dir, statistics)
    blocks = [report.Block("Flag and status", "flag_status")]
    return report.blocks_report(rows, blocks, {"target": "target_group"}, _report_year(), positive_only=True)


def report_household_types(spark, sf_dir):
    return report.shares_report(_report_estimates(spark, sf_dir), "line", "potential", _report_year(), "potential_group")


def report_region(spark, sf_dir):
    rows = b.table(spark, sf_dir, "supplier").join(
        b.table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey"
    )
    rows = lookup_join(rows.withColumnRenamed("n_regionkey", "r_regionkey"), b.table(spark, sf_dir, "region"), ["r_regionkey"])
    rows = rows.withColumns({"w": F.lit(1.0), "year": F.lit(1997), "psu": F.col("s_suppkey")})
    design = SurveyDesign(rows, "w", "r_regionkey", "psu", by=("year",))
    shares = svy_share(design, {"region": F.col("r_name")}, {"solvent": F.col("s_acctbal") > 0})
    regions = b.table(spark, sf_dir, "region").where("r_regionkey < 4")
    table = report.regions_report(shares, "region", _report_year(), regions, "r_name")
    return _rounded(table, {"value": 6})


def coef_table_wide(spark, sf_dir):
    tables = [_one_factor(spark, sf_dir).table(spark, "factor"), _one_number(spark, sf_dir).table(spark, "number")]
    return report.coefficients_report(tables, ["factor", "number"])


def estimates_roundtrip(spark, sf_dir):
    path = _scratch(spark, "estimates")
    saved.write_estimates(_report_estimates(spark, sf_dir), path)
    return _rounded(saved.read_estimates(spark, path, stat="share", var="flag"), {"value": 6})


def landed_estimates(spark, sf_dir):
    """Years landed in two steps, 1995 first with half its rows and then again with all; nothing else is read twice."""
    design, path = b.design(spark, sf_dir, by_year=True), _scratch(spark, "sums")
    early = (F.col("year") < 1995) | ((F.col("year") == 1995) & (F.col("l_orderkey") % 2 == 0))
    for rows in (early, F.col("year") >= 1995):
        part = design.with_data(design.data.where(rows))
        saved.write_sums(additive_sums(part, batch(), b.domains()), path, ["year"])
    sums = saved.read_sums(spark, path)
    return _rounded(estimates_from_sums(design, sums, batch(), list(b.domains())), {"value": 4})


def coef_roundtrip(spark, sf_dir):
    """Two models saved together, one of them read back."""
    path = _scratch(spark, "coefficients")
    tables = [_one_factor(spark, sf_dir).table(spark, "factor"), _one_number(spark, sf_dir).table(spark, "number")]
    saved.write_coefficients(tables[0].unionByName(tables[1]), path)
    rows = saved.read_coefficients(spark, path, "number").select(*FIT_COLUMNS)
    return _rounded(rows, dict.fromkeys(FIT_COLUMNS[1:], 6))


def region_names(spark, sf_dir):
    return saved.read_regions(spark, f"{sf_dir}/region.parquet", "r_name").select("r_regionkey", "category")


def normal_functions(spark, sf_dir):
    """Distribution and density over both tails and the centre."""
    rows = b.table(spark, sf_dir, "lineitem").withColumn("z", F.expr("(l_quantity - 25) / 6"))
    values = {"cdf": F.round(scalars.normal_cdf("z"), 9), "pdf": F.round(scalars.normal_pdf("z"), 9)}
    return rows.select(*b.ROW_KEYS, "l_quantity", *[v.alias(k) for k, v in values.items()])


def text_columns(spark, sf_dir):
    """Labels without their prefix, and a table with every column as text."""
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", scalars.without_prefix("o_orderpriority", 2).alias("priority"))
    return scalars.all_as_text(rows)


def characterisation_study(spark, sf_dir):
    """All totals, shares and means of the three sub-populations by year, on the survey view of the tables."""
    return _rounded(studies.characterisation_study(survey_view.annual(spark, sf_dir)), {"value": 4})


def dropout_study_se(spark, sf_dir):
    """The same study with the design's standard errors, as its users call it."""
    waves = survey_view.waves(spark, sf_dir)
    results = studies.dropout_study(waves, b.WAVES, se="taylor", lonely_psu="remove")
    return _rounded(results, {"value": 4, "std_error": 4})


QUERIES = {
    "dropout_study_se": dropout_study_se,
    "characterisation_study": characterisation_study,
    "coef_roundtrip": coef_roundtrip,
    "region_names": region_names,
    "normal_functions": normal_functions,
    "text_columns": text_columns,
    "household_income": household_income,
    "household_income_annual": household_income_annual,
    "parent_max": parent_max,
    "region_recode": region_recode,
    "category_recode": category_recode,
    "person_key": person_key,
    "audience_flags": audience_flags,
    "hourly_wage": hourly_wage,
    "deflator_join": deflator_join,
    "label_decode": label_decode,
    "quarterly_waves": quarterly_waves,
    "annual_files": annual_files,
    "fixed_width_read": fixed_width_read,
    "raw_quarters": raw_quarters,
    "raw_quarter_counts": raw_quarter_counts,
    "baseline_cohort": baseline_cohort,
    "pair_dropout": pair_dropout,
    "dropout_semi": dropout_semi,
    "attrition_anti": attrition_anti,
    "survival_table": survival_table,
    "monthly_survival": monthly_survival,
    "monthly_dropout": monthly_dropout,
    "matched_waves": matched_waves,
    "evasion_flag": evasion_flag,
    "cohort_covariates": cohort_covariates,
    "svy_total": svy_total_query,
    "svy_total_by": svy_total_by_query,
    "svy_share": svy_share_query,
    "svy_mean": svy_mean_query,
    "svy_interaction": svy_interaction_query,
    "svy_batch": svy_batch,
    "svy_poststratify": svy_poststratify,
    "svy_se_taylor": svy_se_taylor,
    "svy_se_poststratified": svy_se_poststratified,
    "svy_se_replicate": svy_se_replicate,
    "svy_se_bootstrap": svy_se_bootstrap,
    "km_curve": km_curve,
    "km_curve_by": km_curve_by,
    "cox_fit": cox_fit,
    "cox_one_binary": cox_one_binary,
    "wls_one_factor": wls_one_factor,
    "wls_one_number": wls_one_number,
    "wls_sandwich_se": wls_sandwich_se,
    "wls_many_levels": wls_many_levels,
    "wls_significance": wls_significance,
    "mincer_fit": mincer_fit,
    "probit_fit": probit_fit,
    "probit_populations": probit_populations,
    "probit_one_factor": probit_one_factor,
    "probit_one_number": probit_one_number,
    "evasion_probit": evasion_probit,
    "mills_ratio": mills_ratio,
    "residual_impute": residual_impute,
    "heckman_two_step": heckman_two_step_query,
    "heckman_one_number": heckman_one_number,
    "dropout_study": dropout_study,
    "report_totals": report_totals,
    "report_blocks": report_blocks,
    "report_shares": report_shares,
    "report_household_types": report_household_types,
    "report_region": report_region,
    "coef_table_wide": coef_table_wide,
    "estimates_roundtrip": estimates_roundtrip,
    "landed_estimates": landed_estimates,
}
