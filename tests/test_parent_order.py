"""Two whole-number order columns keep the choice of parents in hash mode."""

from pyspark.sql import functions as F

from panelweave.operators.household import ParentRoles, parents_schooling


def test_packed_order_needs_no_sort(spark):
    rows = [(1, 2, 5, 1, 2, 7), (1, 1, 9, 1, 2, None), (1, 1, 8, 2, 2, 3), (2, 1, 1, 1, 1, 4), (2, None, 2, 1, 1, 6), (3, 1, 1, 2, 3, 5)]
    people = spark.createDataFrame(rows, "house int, line int, visit long, relation int, sex int, schooling int")
    roles = ParentRoles(F.col("sex"), F.col("relation"), F.col("schooling"), ["line", "visit"])
    frame = parents_schooling(people, "house", roles)
    assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {r.house: (r.mother_edu, r.father_edu) for r in frame.collect()}
    assert found == {1: (3, None), 2: (None, 6), 3: (None, None)}
