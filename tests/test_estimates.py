from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.estimate import Statistics, estimates, svy_interaction, svy_mean, svy_share, svy_total
from panelweave.plans import bindings as b

ROWS = [
    # stratum, cluster, weight, in domain, category, value
    (1, "a", 2.0, True, "x", 10.0),
    (1, "a", 1.0, True, None, 4.0),
    (1, "b", 3.0, True, "y", None),
    (1, "c", 5.0, False, "x", 7.0),
    (2, "d", 1.0, True, "x", 2.0),
    (2, "e", 4.0, None, "y", 1.0),
]
SCHEMA = "h int, c string, w double, inside boolean, cat string, v double"


@pytest.fixture(scope="module")
def design(spark):
    return SurveyDesign(spark.createDataFrame(ROWS, SCHEMA), "w", "h", "c")


def value(frame, **where):
    for column, wanted in where.items():
        frame = frame.where(F.col(column).eqNullSafe(F.lit(wanted)))
    return frame.collect()[0]


def test_missing_value_leaves_only_its_own_variable(design):
    domain = {"d": F.col("inside")}
    assert value(svy_total(design, domain))["value"] == 7.0
    assert value(svy_share(design, {"cat": F.col("cat")}, domain), level="x")["value"] == pytest.approx(3.0 / 6.0)
    assert value(svy_mean(design, {"v": F.col("v")}, domain))["value"] == pytest.approx((20.0 + 4.0 + 2.0) / 4.0)


def test_clusters_without_domain_rows_count(design):
    """Total over clusters a 3, b 3, c 0 and d 1, e 0."""
    row = value(svy_total(design, {"d": F.col("inside")}, "taylor"))
    first = 3 / 2 * ((3 - 2) ** 2 + (3 - 2) ** 2 + (0 - 2) ** 2)
    second = 2 / 1 * (0.5**2 + 0.5**2)
    assert row["std_error"] == pytest.approx((first + second) ** 0.5)


def test_single_cluster_stratum(spark, design):
    lonely = design.with_data(design.data.where("c <> 'e'"))
    with pytest.raises(PySparkException, match="stratum with one cluster: 2"):
        svy_total(lonely, se="taylor").collect()
    removed = replace(lonely, lonely_psu="remove")
    assert value(svy_total(removed, {"d": F.col("inside")}, "taylor"))["std_error"] == pytest.approx(9.0**0.5)
    with pytest.raises(ValueError):
        replace(design, lonely_psu="guess")


def test_interaction_lists_empty_combinations(design):
    levels = {"cat": ("x", "y"), "h": ("1", "2", "3")}
    rows = svy_interaction(design, "both", ["cat", "h"], levels, {"d": F.col("inside")}, "taylor").collect()
    got = {r["level"]: r["value"] for r in rows}
    assert got == pytest.approx({"x.1": 2 / 6, "y.1": 3 / 6, "x.2": 1 / 6, "y.2": 0.0, "x.3": 0.0, "y.3": 0.0})
    assert {r["std_error"] for r in rows if r["value"] == 0.0} == {0.0}


def test_shares_sum_to_one(spark, small_dir):
    wanted = Statistics(shares={"flag": b.flag(), "status": b.status(), "line": F.col("l_linenumber")})
    sums = (
        estimates(b.design(spark, small_dir, by_year=True), wanted, b.domains())
        .groupBy("year", "subpop", "var")
        .agg(F.sum("value").alias("total"))
        .collect()
    )
    assert sums and all(r["total"] == pytest.approx(1.0) for r in sums)


@pytest.mark.parametrize("totals", ["mapping", "column"])
def test_poststratified_weights_reach_known_totals(spark, small_dir, totals):
    design = b.design(spark, small_dir)
    if totals == "column":
        known = F.when(F.col("l_returnflag") == "N", 230000.0).otherwise(120000.0)
        adjusted = poststratify(design.with_columns({"known": known}), "l_returnflag", "known")
    else:
        adjusted = poststratify(design, "l_returnflag", b.TOTALS)
    sums = adjusted.data.groupBy("l_returnflag").agg(F.sum(adjusted.weight)).collect()
    assert {r[0]: r[1] for r in sums} == pytest.approx(b.TOTALS)


def test_poststratum_without_total_is_refused(spark, small_dir):
    with pytest.raises(PySparkException, match="without a known total: R"):
        poststratify(b.design(spark, small_dir), "l_returnflag", {"A": 1.0, "N": 1.0}).data.count()


def test_poststratified_total_of_a_poststratum_is_certain(spark, small_dir):
    adjusted = poststratify(b.design(spark, small_dir), "l_returnflag", b.TOTALS)
    row = value(svy_total(adjusted, {"a": F.col("l_returnflag") == "A"}, "taylor"))
    assert row["value"] == pytest.approx(120000.0) and row["std_error"] == pytest.approx(0.0, abs=1e-6)


def test_batch_equals_separate_estimates(spark, small_dir):
    design = b.design(spark, small_dir)
    wanted = Statistics(shares={"flag": b.flag(), "status": b.status()}, means={"price": b.price()})
    fused = estimates(design, wanted, b.domains())
    apart = svy_share(design, {"flag": b.flag()}, b.domains()).unionByName(
        svy_share(design, {"status": b.status()}, b.domains())
    ).unionByName(svy_mean(design, {"price": b.price()}, b.domains()))

    def key(r):
        return (r["subpop"], r["stat"], r["var"], r["level"])

    one, two = ({key(r): r["value"] for r in f.collect()} for f in (fused, apart))
    assert one == pytest.approx(two)


def test_batch_reads_the_table_once(spark, small_dir):
    plan = estimates(b.design(spark, small_dir), Statistics(True, shares={"flag": b.flag()}), b.domains())
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_replicates_by_year(spark, small_dir):
    weights = {f"r{k}": F.expr(f"w * (1 + ((l_orderkey * {k}) % 5 - 2) / 10)") for k in (1, 2, 3)}
    design = replace(b.design(spark, small_dir, by_year=True).with_columns(weights), replicates=tuple(weights))
    wanted = Statistics(population=True, shares={"status": b.status()}, means={"price": b.price()})
    got = {
        (r["year"], r["stat"], r["level"]): (r["value"], r["std_error"])
        for r in estimates(design, wanted, {"p": F.expr("l_discount >= 0.09")}, "replicate").collect()
    }
    rows = design.data.where("l_discount >= 0.09").toPandas()
    assert set(rows.year) == {y for y, _, _ in got}
    for year, part in rows.groupby("year"):
        known = part[part.l_linenumber != 3]
        priced = part[part.l_quantity > 5]
        for key, points in {
            ("total", None): [part[w].sum() for w in ("w", *weights)],
            ("share", "F"): [known[known.l_linestatus == "F"][w].sum() / known[w].sum() for w in ("w", *weights)],
            ("mean", None): [(priced[w] * priced.l_extendedprice).sum() / priced[w].sum() for w in ("w", *weights)],
        }.items():
            error = (sum((p - points[0]) ** 2 for p in points[1:]) / 3) ** 0.5
            assert got[(year, *key)] == pytest.approx((points[0], error))


def test_unknown_standard_error_is_refused(design):
    with pytest.raises(ValueError):
        svy_total(design, se="jackknife")


@pytest.mark.parametrize("known,weight", [("NULL", "1.0"), ("CASE WHEN id < 5 THEN 10.0 ELSE 20.0 END", "1.0"), ("10.0", "0.0")])
def test_poststratum_columns_without_one_total_are_refused(spark, known, weight):
    rows = spark.range(20).selectExpr("id", "id % 2 AS h", "id % 5 AS c", "'g' AS g", f"CAST({weight} AS DOUBLE) AS w", f"CAST({known} AS DOUBLE) AS known")
    with pytest.raises(Exception, match="post-stratum without"):
        poststratify(SurveyDesign(rows, "w", "h", "c"), "g", "known").data.agg({"weight_adj": "sum"}).collect()


def test_a_missing_stratum_is_refused_with_errors(spark):
    rows = spark.range(40).selectExpr("nullif(id % 4, 3) AS h", "id % 10 AS c", "1.0D AS w", "id % 2 AS x")
    design = SurveyDesign(rows, "w", "h", "c")
    assert svy_total(design).first()["value"] == 40
    with pytest.raises(Exception, match="a row of the design has no h"):
        svy_total(design, se="taylor").collect()
