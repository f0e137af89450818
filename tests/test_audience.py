from pyspark.sql import functions as F

from panelweave.operators import audience

SCHEMA = "age int, income double, benefit boolean, other boolean, schooling string, course string, alone boolean, sector string"
LEVELS = ("completed", "started")


def flags(spark, **row):
    base = dict(age=16, income=500.0, benefit=False, other=False, schooling="completed", course="upper", alone=False, sector="p")
    frame = spark.createDataFrame([{**base, **row}], SCHEMA)
    c = F.col
    in_course = audience.equal_all([(c("course"), "upper")])
    benefits = [c("benefit"), c("other")]
    conditions = {
        "target_q": audience.target_quarterly(c("age"), in_course, c("income"), c("alone")),
        "potential_q": audience.potential_quarterly(c("age"), c("income"), c("schooling"), LEVELS),
        "target_a": audience.target_annual(c("age"), in_course, c("income"), benefits, c("alone")),
        "potential_a": audience.potential_annual(c("age"), c("income"), benefits, c("schooling"), LEVELS),
        "wage": audience.wage_sample(c("age"), c("sector"), "public"),
        "selection": audience.selection_sample(c("age"), c("sector"), "public"),
    }
    return frame.select(*[audience.flag(v).alias(k) for k, v in conditions.items()]).first().asDict()


def test_poor_student_is_in_all_groups(spark):
    got = flags(spark)
    assert got["target_q"] and got["potential_q"] and got["target_a"] and got["potential_a"]


def test_benefit_stands_in_for_unknown_income(spark):
    got = flags(spark, income=None, benefit=True, other=None)
    assert got["target_a"] and not got["target_q"]
    assert not flags(spark, income=None, benefit=None, other=False)["target_a"]


def test_started_schooling_admits_anyone_in_the_annual_form(spark):
    got = flags(spark, age=60, income=99999.0, schooling="started")
    assert got["potential_a"] and not got["potential_q"]


def test_one_person_household_and_limit(spark):
    assert not flags(spark, alone=True)["target_q"]
    assert flags(spark, income=660.0)["target_q"] and not flags(spark, income=660.01)["target_q"]


def test_unknown_sector(spark):
    got = flags(spark, age=30, sector=None)
    assert got["selection"] and not got["wage"]
    got = flags(spark, age=30, sector="public")
    assert not got["selection"] and not got["wage"]
    assert flags(spark, age=25)["wage"] and not flags(spark, age=24)["wage"]


def test_grades_and_years(spark):
    frame = spark.createDataFrame([("1", 2005), (None, 9999), ("9", None)], "grade string, year int")
    rows = frame.select(
        audience.flag(audience.grade_in(F.col("grade"), ["1"])),
        audience.flag(audience.grade_in(F.col("grade"), ["1"], or_missing=True)),
        audience.flag(audience.birth_year_known(F.col("year"))),
    ).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, True, False), (False, False, False)]
