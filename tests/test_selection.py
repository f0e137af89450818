import math

import pytest
from pyspark.sql import functions as F

from panelweave.operators import selection


def donors(spark):
    return spark.range(0, 300, 1, 4).select((F.col("id") % 50).alias("donor"), (F.col("id") % 50).cast("double").alias("value"))


def test_numbering_has_no_gaps_and_keeps_copies(spark, monkeypatch):
    monkeypatch.setattr(selection, "PIECE", 4)
    monkeypatch.setattr(selection, "BLOCK", 3)
    blocks, size = selection._numbered(donors(spark), ["donor"], "value")
    found = blocks.collect()
    numbers = [(n, r["value"]) for r in found for n in range(r["__first"], r["__last"] + 1) if n // 3 == r["__block"]]
    assert sorted(n for n, _ in numbers) == list(range(300))
    assert {v: sum(x == v for _, x in numbers) for v in (0.0, 49.0)} == {0.0: 6, 49.0: 6}
    assert spark.range(1).select(size).first()[0] == 300


def test_copies_of_a_donor_are_not_multiplied(spark):
    many = spark.range(300_000).select(F.lit(1).alias("donor"), F.lit(2.5).alias("value"))
    blocks, _ = selection._numbered(many, ["donor"], "value")
    assert blocks.count() == 1 + (300_000 - 1) // selection.BLOCK
    targets = spark.range(1000).withColumnRenamed("id", "person")
    drawn = selection.draw_residuals(targets, ["person"], many, ["donor"], "value", 1)
    assert drawn.where("drawn_residual = 2.5").count() == 1000


def test_draw_does_not_depend_on_partitions(spark, settings):
    targets = spark.range(500).withColumnRenamed("id", "person")

    def draw(frame, seed=1):
        out = selection.draw_residuals(frame, ["person"], donors(spark), ["donor"], "value", seed)
        return {r["person"]: r["drawn_residual"] for r in out.collect()}

    one = draw(targets.repartition(1))
    settings(spark__sql__shuffle__partitions="3")
    assert draw(targets.repartition(7)) == one
    assert draw(targets, seed=2) != one
    assert len(one) == 500 and None not in one.values()


def test_draw_is_uniform_over_donors(spark):
    targets = spark.range(40_000).withColumnRenamed("id", "person")
    weighted = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "value double").union(
        spark.createDataFrame([(None,)], "value double")
    )
    out = selection.draw_residuals(targets, ["person"], weighted, ["value"], "value", seed=5)
    share = out.agg(F.avg("drawn_residual")).first()[0]
    assert share == pytest.approx(0.25, abs=5 * math.sqrt(0.25 * 0.75 / 40_000))
