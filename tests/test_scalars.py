import math

import pytest
from pyspark.sql import functions as F

from panelweave.functions import scalars as s


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_key_writes_missing_parts_as_na(spark):
    rows = [("a", None, 3), (None, "b", None)]
    assert values(spark, s.text_key("x", "y", "z", sep="_"), rows, "x string, y string, z int") == ["a_NA_3", "NA_b_NA"]
    assert values(spark, s.text_key("x", "y", "z"), rows, "x string, y string, z int") == ["aNA3", "NAbNA"]


def test_recode_leaves_unmatched_null(spark):
    mapping = {"Preta": "Preta ou Parda", "Parda": "Preta ou Parda", "Branca": "Branca"}
    rows = [("Parda",), ("Preta",), ("Branca",), ("?",), (None,)]
    assert values(spark, s.recode("x", mapping), rows, "x string") == ["Preta ou Parda"] * 2 + ["Branca", None, None]


def test_region_reads_first_character(spark):
    names = {"1": "Norte", "5": "Centro-Oeste"}
    assert values(spark, s.region_from_key("x", names), [("1234",), ("55",), ("9",), (None,)], "x string") == [
        "Norte", "Centro-Oeste", None, None,
    ]


def test_unknown_relation_is_not_a_member(spark):
    rows = [("lodger",), ("child",), (None,)]
    assert values(spark, s.member_flag("r", ["lodger"]), rows, "r string") == [None, 1.0, None]
    assert values(spark, s.members_only(F.lit(5), "r", ["lodger"]), rows, "r string") == [None, 5, None]


def test_hourly_wage_guards_zeros(spark):
    # zero hours -> NULL, zero wage -> 0 with log 0, missing wage -> NULL
    rows = [(430.0, 10.0), (100.0, 0.0), (0.0, 10.0), (None, 10.0)]
    hourly = s.hourly_wage("w", "h")
    got = values(spark, hourly, rows, "w double, h double")
    assert got[0] == pytest.approx(10.0) and got[1:] == [None, 0.0, None]
    logs = values(spark, s.log_or_zero(hourly), rows, "w double, h double")
    assert logs[0] == pytest.approx(math.log(10.0)) and logs[1:] == [None, 0.0, None]
    assert values(spark, s.is_employed("w"), rows, "w double, h double") == [1, 1, 0, 0]


def test_percent_text(spark):
    rows = [(0.125,), (0.12,), (0.0,), (1.0,), (0.00123,), (None,)]
    assert values(spark, s.percent_text("x"), rows, "x double") == ["12.5%", "12%", "0%", "100%", "0.12%", None]
    assert values(spark, s.percent_text("x", 0), [(0.125,), (0.135,)], "x double") == ["12%", "14%"]


def test_number_text_has_no_exponent(spark):
    rows = [(12.0,), (12.5,), (123456789.25,)]
    assert values(spark, s.number_text("x"), rows, "x double") == ["12", "12.5", "123456789.25"]


def test_without_prefix_and_all_as_text(spark):
    assert values(spark, s.without_prefix("x", 2), [("GRNorte",)], "x string") == ["Norte"]
    frame = s.all_as_text(spark.createDataFrame([(1, 2.5, None)], "a int, b double, c string"))
    assert frame.collect()[0] == ("1", "2.5", None)


def test_row_max_skips_missing(spark):
    assert values(spark, s.row_max("a", "b"), [(1, 2), (None, 3), (None, None)], "a int, b int") == [2, 3, None]


def test_normal_functions_match_erfc(spark):
    grid = [(i / 16.0,) for i in range(-560, 161)]
    frame = spark.createDataFrame(grid, "z double").select("z", s.normal_cdf("z"), s.normal_pdf("z"), s.inverse_mills("z"))
    for z, cdf, pdf, mills in frame.collect():
        exact = 0.5 * math.erfc(-z / math.sqrt(2.0))
        density = math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        assert cdf == pytest.approx(exact, rel=1e-12)
        assert pdf == pytest.approx(density, rel=1e-14)
        assert mills == pytest.approx(density / exact, rel=1e-12)
    far = spark.createDataFrame([(-200.0,), (None,)], "z double").select(s.inverse_mills("z")).collect()
    assert far[0][0] == pytest.approx(200.0 + 1 / 200.0, rel=1e-6) and far[1][0] is None
