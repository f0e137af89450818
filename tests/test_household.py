import pytest
from pyspark.sql import functions as F

from panelweave.operators.household import IncomeRoles, IncomeSource, ParentRoles, household_profile
from panelweave.operators.skew import attach_groups, lookup_join, order_key
from panelweave.plans import bindings as b

PEOPLE = [
    # household, position, relation, income, sex, relation code, schooling
    ("a", 1, "head", 100.0, 2, 1, 5),
    ("a", 2, "child", None, 1, 3, 4),
    ("a", 3, "lodger", 900.0, 1, 7, 9),
    ("b", 1, "lodger", 500.0, 2, 7, 3),
    ("c", 1, None, 50.0, None, 1, 8),
    ("c", 2, "head", 30.0, 2, 1, 6),
    ("d", 1, "head", 1.0, 2, 1, None),
    ("d", 2, "parent", 1.0, 2, 6, 9),
    ("d", 3, "spouse", 1.0, 1, 2, 5),
    ("e", 1, "child", 7.0, 1, 3, 2),
]
SCHEMA = "hh string, position int, relation string, income double, sex int, code int, school int"


@pytest.fixture(scope="module")
def profile(spark):
    people = spark.createDataFrame(PEOPLE, SCHEMA)
    two = F.lit(2.0)
    income = IncomeRoles(F.col("relation"), ["lodger"], [IncomeSource(F.col("income"), two, two)])
    parents = ParentRoles(F.col("sex"), F.col("code"), F.col("school"), ["position"])
    rows = household_profile(people, "hh", income=income, parents=parents).collect()
    return {(r["hh"], r["position"]): r for r in rows}


def test_missing_income_counts_as_zero_and_lodgers_see_nothing(profile):
    assert (profile["a", 1]["income_own"], profile["a", 1]["members"], profile["a", 1]["pc_own"]) == (200.0, 2.0, 100.0)
    assert profile["a", 3]["income_own"] is None and profile["a", 3]["pc_last"] is None


def test_household_without_members(profile):
    row = profile["b", 1]
    assert row["members"] == 0.0 and row["pc_own"] is None


def test_unknown_relation_is_left_out(profile):
    assert profile["c", 2]["members"] == 1.0 and profile["c", 2]["income_own"] == 60.0
    assert profile["c", 1]["pc_own"] is None


def test_first_mother_counts_even_with_unknown_schooling(profile):
    row = profile["d", 3]
    assert (row["mother_edu"], row["father_edu"], row["parent_max"]) == (None, 5, 5)


def test_unknown_membership_before_the_first_match_hides_it(profile):
    assert profile["c", 1]["mother_edu"] is None and profile["c", 1]["father_edu"] is None


def test_no_parent(profile):
    assert profile["e", 1]["parent_max"] is None


def test_single_order_column_keeps_hash_aggregation(spark):
    people = spark.createDataFrame(PEOPLE, SCHEMA)
    parents = ParentRoles(F.col("sex"), F.col("code"), F.col("school"), ["position"])
    plan = household_profile(people, "hh", parents=parents)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_same_result_for_any_number_of_partitions(spark, small_dir, settings):
    rows = b.table(spark, small_dir, "lineitem")

    def run():
        out = household_profile(rows, "l_orderkey", b.annual_income(), b.parent_roles())
        return sorted(
            (r[0], r[1], r[2], r["parent_max"] or -1, round(r["pc_own"] or -1, 4))
            for r in out.select(*b.ROW_KEYS[:3], "parent_max", "pc_own").collect()
        )

    settings(spark__sql__shuffle__partitions="1")
    one = run()
    settings(spark__sql__shuffle__partitions="8")
    assert run() == one


def test_hot_household_is_split_over_tasks(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20000",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    rows = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("hh"), F.sha2(F.col("id").cast("string"), 256).alias("person")
    )
    groups = rows.groupBy("hh").agg(F.count(F.lit(1)).alias("size"))
    joined = attach_groups(rows, groups, ["hh"]).agg(F.sum("size"), F.count("person"), F.max("person"))
    assert joined.collect()[0][:2] == (20_001**2 + 39_999, 60_000)
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how,expected", [("left", 4), ("inner", 2), ("left_semi", 2), ("left_anti", 2)])
def test_attach_keeps_or_drops_rows_without_a_group(spark, how, expected):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    groups = spark.createDataFrame([("a", 10), ("z", 20)], "k string, g int")
    assert attach_groups(rows, groups, ["k"], how).count() == expected


def test_lookup_of_any_size_gives_the_same(spark, settings):
    rows = spark.range(100).withColumnRenamed("id", "k")
    lookup = spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    small = sorted(map(tuple, lookup_join(rows, lookup, ["k"]).collect()), key=str)
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    large = lookup_join(rows, lookup, ["k"])
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, large.collect()), key=str) == small


def test_packed_order_equals_the_struct(spark):
    rows = [(None, 5), ("2020-01-01", None), ("2020-01-01", -(2**63)), ("2020-01-01", 2**63 - 1), ("1969-01-01", 7), ("2020-01-02", -3), (None, None)]
    frame = spark.createDataFrame(rows, "d string, k long").withColumn("d", F.to_date("d"))
    packed, plain = order_key(["d", "k"], frame.schema), F.struct("d", "k")
    assert [tuple(r) for r in frame.orderBy(packed).collect()] == [tuple(r) for r in frame.orderBy(plain).collect()]


def test_panel_aggregates_hash(spark, small_dir):
    from panelweave.plans.queries import QUERIES

    for name in ("survival_table", "pair_dropout", "dropout_semi", "matched_waves", "attrition_anti", "evasion_flag"):
        plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name
