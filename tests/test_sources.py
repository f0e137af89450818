import re

import pytest
from pyspark.sql import functions as F

from panelweave.operators import report
from panelweave.plans import bindings as b
from panelweave.sources import estimates as saved
from panelweave.sources import microdata


def test_fixed_width_blanks_and_bad_numbers(spark, tmp_path):
    path = str(tmp_path / "records")
    spark.createDataFrame([("012 A 7",), ("x12   8",)], "value string").coalesce(1).write.text(path)
    layout = [
        microdata.FixedField("n", 1, 3, "int"),
        microdata.FixedField("s", 5, 1),
        microdata.FixedField("d", 6, 2, "double"),
    ]
    rows = {tuple(r) for r in microdata.read_fixed_width(spark, path, layout).collect()}
    assert rows == {(12, "A", 7.0), (None, None, 8.0)}


def test_labels_keep_codes(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (9, "a")], "sex int, area string")
    dictionary = spark.createDataFrame(
        [("sex", "1", "M"), ("sex", "2", "F"), ("area", "a", "urban"), ("area", "b", "rural"), ("other", "1", "?")],
        "var string, code string, label string",
    )
    expected = [(1, "b", "M", "rural"), (2, None, "F", None), (9, "a", None, "urban")]

    def decoded():
        out = microdata.decode_labels(rows, dictionary, ["sex", "area"])
        return sorted(tuple(r) for r in out.select("sex_code", "area_code", "sex", "area").collect())

    assert decoded() == expected


@pytest.mark.parametrize("size", [3, 5000])
def test_a_code_with_two_labels_is_refused_in_any_size(spark, size):
    rows = spark.createDataFrame([(1, True)], "sex int, yes boolean")
    entries = [("sex", str(i), f"label {i}") for i in range(size)] + [("sex", "1", "label 1"), ("yes", "true", "Y")]
    dictionary = spark.createDataFrame(entries, "var string, code string, label string")
    assert [tuple(r) for r in microdata.decode_labels(rows, dictionary, ["sex", "yes"]).select("sex", "yes").collect()] == [("label 1", "Y")]
    conflict = dictionary.union(spark.createDataFrame([("sex", "1", "another")], dictionary.schema))
    with pytest.raises(Exception, match="two labels of sex for code 1"):
        microdata.decode_labels(rows, conflict, ["sex"]).collect()


def test_waves_are_numbered_across_years_and_pruned(spark, tmp_path):
    path = str(tmp_path / "waves")
    rows = spark.range(80).selectExpr("id", "CAST(2022 + id % 3 AS INT) AS year", "CAST(1 + id % 4 AS INT) AS quarter")
    microdata.write_microdata(rows, path, ["year", "quarter"])
    waves = microdata.read_quarters(spark, path, {2023: [1, 4], 2022: [2]})
    got = {(r["year"], r["quarter"]): r["wave"] for r in waves.select("year", "quarter", "wave").distinct().collect()}
    assert got == {(2022, 2): 1, (2023, 1): 2, (2023, 4): 3}
    plan = waves._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan)


def test_deflators_missing_stay_null(spark):
    rows = spark.createDataFrame([(2023, "SP", 10.0), (2022, "SP", 10.0)], "year int, area string, income double")
    deflators = spark.createDataFrame([(2023, "SP", 1.5)], "year int, area string, deflator double")
    out = microdata.attach_deflators(rows, deflators, ["year", "area"])
    assert {r["year"]: r["deflator"] for r in out.collect()} == {2023: 1.5, 2022: None}


def test_saved_tables_come_back(spark, small_dir, tmp_path):
    from panelweave.plans.queries import _one_number, _report_estimates

    results = _report_estimates(spark, small_dir)
    saved.write_estimates(results, str(tmp_path / "estimates"))
    back = saved.read_estimates(spark, str(tmp_path / "estimates"))
    assert back.count() == results.count()
    one = saved.read_estimates(spark, str(tmp_path / "estimates"), "mean", "price")
    assert one.count() == results.where("stat = 'mean' AND var = 'price'").count() > 0
    table = _one_number(spark, small_dir).table(spark, "number")
    saved.write_coefficients(table, str(tmp_path / "coefficients"))
    assert saved.read_coefficients(spark, str(tmp_path / "coefficients"), "number").count() == 2
    b.table(spark, small_dir, "region").write.parquet(str(tmp_path / "regions"))
    assert "category" in saved.read_regions(spark, str(tmp_path / "regions"), "r_name").columns


def test_report_keeps_categories_known_to_one_group(spark):
    rows = [(2022, "t", "share", "sex", "F", 0.125), (2022, "p", "share", "sex", "M", 0.12), (2021, "t", "share", "sex", "M", 0.5)]
    estimates = spark.createDataFrame(rows, "year int, subpop string, stat string, var string, level string, value double")
    table = report.blocks_report(estimates, [report.Block("Sex", "sex")], {"t": "T", "p": "P"}, F.col("year") == 2022)
    assert [tuple(r) for r in table.orderBy("block", "ord").collect()] == [
        (1, 0, "Sex", None, None), (1, 1, "F", "12.5%", None), (1, 2, "M", None, "12%"),
    ]


def test_coefficient_stars(spark):
    schema = "model string, term string, estimate double, std_error double, statistic double, p_value double, converged boolean"
    one = spark.createDataFrame([("m", "a", 1.23456, 0.1, 12.0, 1e-6, True), ("m", "b", None, None, None, None, True)], schema)
    two = spark.createDataFrame([("n", "a", -0.5, 0.25, -2.0, 0.04, True), ("n", "c", 0.1, 0.25, 0.4, 0.7, True)], schema)
    wide = {r["term"]: (r["m"], r["n"]) for r in report.coefficients_report([one, two], ["m", "n"]).collect()}
    assert wide == {"a": ("1.235*** (0.100)", "-0.500* (0.250)"), "b": (None, None), "c": (None, "0.100 (0.250)")}
