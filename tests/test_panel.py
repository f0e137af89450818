import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel

ROWS = [
    ("never_left", 1, "S"), ("never_left", 2, "S"), ("never_left", 3, None), ("never_left", 4, "S"),
    ("absent_then_out", 1, "S"), ("absent_then_out", 3, "N"),
    ("unknown_then_absent", 1, "S"), ("unknown_then_absent", 2, None), ("unknown_then_absent", 4, "N"),
    ("out2", 1, "S"), ("out2", 2, "N"), ("out2", 3, "S"),
    ("out4", 1, "S"), ("out4", 2, "S"), ("out4", 3, "S"), ("out4", 4, "N"),
    ("gone", 1, "S"),
    ("not_in_cohort", 1, "N"), ("not_in_cohort", 2, "N"),
    ("late", 2, "S"), ("late", 3, "N"),
]


@pytest.fixture(scope="module")
def waves(spark):
    return spark.createDataFrame(ROWS, "id string, wave int, school string")


def attends():
    return F.col("school") == "S"


def left():
    return F.col("school") == "N"


def test_survival_table(waves):
    table = panel.survival_table(waves, "id", "wave", [1, 2, 3, 4], attends(), left())
    assert {r["id"]: (r["time"], r["status"]) for r in table.collect()} == {
        "never_left": (4, 0),
        "absent_then_out": (1, 0),
        "unknown_then_absent": (2, 0),
        "out2": (2, 1),
        "out4": (4, 1),
        "gone": (1, 0),
    }


def test_survival_table_is_one_shuffle(waves):
    plan = panel.survival_table(waves, "id", "wave", [1, 2, 3, 4], attends(), left())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "SortAggregate" not in text


def test_pair_dropouts(waves):
    pairs = panel.pair_dropouts(waves, "id", "wave", [1, 2, 3, 4], F.lit(True), attends(), left())
    assert {tuple(r) for r in pairs.collect()} == {("out2", 1), ("out4", 3), ("late", 2)}


def test_rows_of_keeps_full_rows(waves):
    pairs = panel.pair_dropouts(waves, "id", "wave", [1, 2, 3, 4], F.lit(True), attends(), left())
    kept = panel.rows_of(waves, pairs, ["id", "wave"])
    assert {(r["id"], r["wave"], r["school"]) for r in kept.collect()} == {("out2", 1, "S"), ("out4", 3, "S"), ("late", 2, "S")}
    assert panel.rows_of(waves, pairs, ["id", "wave"], keep=False).count() == len(ROWS) - 3


def test_attrition(waves):
    absent = panel.attrition(waves, "id", "wave", (1, 2), attends())
    assert {r["id"] for r in absent.collect()} == {"absent_then_out", "gone"}


def test_evasion_resets_graduates(spark):
    rows = [
        ("left", 1, "S", "1"), ("left", 2, "N", None),
        ("graduated", 1, "S", "3"), ("graduated", 2, "N", None),
        ("left_last", 1, "S", "3"), ("left_last", 2, "N", "3"),
        ("stays", 1, "S", "2"), ("stays", 2, "S", "3"),
        ("other_follow", 1, "S", "2"), ("other_follow", 2, "N", "9"),
        ("absent", 1, "S", "2"),
    ]
    frame = spark.createDataFrame(rows, "id string, wave int, school string, grade string")
    grade = F.col("grade")
    flags = panel.evasion_flags(
        frame, "id", "wave", (1, 2), grade.isin("1", "2", "3"), grade.isin("1", "2", "3") | grade.isNull(),
        attends(), left(), grade == "3", grade.isNull(),
    )
    assert {r["id"]: r["evaded"] for r in flags.collect()} == {"left": 1, "graduated": 0, "left_last": 1, "stays": 0}


def test_last_row_of_a_wave_counts(spark):
    rows = [("p", 1, 1, "N"), ("p", 1, 2, "S"), ("p", 2, 5, "N"), ("p", 2, 4, "S")]
    frame = spark.createDataFrame(rows, "id string, wave int, visit int, school string")
    table = panel.survival_table(frame, "id", "wave", [1, 2], attends(), left(), order=["visit"])
    assert [tuple(r) for r in table.collect()] == [("p", 1, 2)]


def test_matched_waves_and_cohort(waves):
    matched = panel.matched_waves(waves, "id", "wave", (1, 2), {"s": F.col("school")})
    assert {tuple(r) for r in matched.collect()} == {
        ("never_left", "S", "S"), ("unknown_then_absent", "S", None), ("out2", "S", "N"), ("out4", "S", "S"),
        ("not_in_cohort", "N", "N"),
    }
    assert panel.baseline_cohort(waves, "wave", 1, [attends()]).count() == 6


def test_survival_cells_partition_the_cohort(spark, medium_dir):
    from panelweave.plans.queries import survival_table

    cells = survival_table(spark, medium_dir).groupBy("time", "status").count().collect()
    assert {(r["time"], r["status"]): r["count"] for r in cells} == {
        (1, 0): 80, (2, 0): 34, (2, 1): 116, (3, 0): 21, (3, 1): 52, (4, 0): 8, (4, 1): 21,
        (5, 0): 6, (5, 1): 13, (6, 0): 9, (6, 1): 5, (7, 0): 3, (7, 1): 3,
    }
