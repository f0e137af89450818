"""Fits with a factor of thousands of levels, and what they are built of."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.scalars import number_of
from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.glm import fit_linear, fit_probit, residuals
from panelweave.operators.model import Factor, Layout, Number, independent_columns, symmetric
from panelweave.operators.products import CrossProduct, Shape

LEVELS = 2000


def test_numbers_of_texts(spark):
    numbers = {f"k{i}": i * 0.1 for i in range(1000)} | {"": 7.0, 'q"\\': 8.0, "é": 9.0}
    rows = spark.createDataFrame([(k,) for k in [*numbers, "other", None]], "k string")
    found = {r["k"]: r["n"] for r in rows.select("k", number_of("k", numbers).alias("n")).collect()}
    assert found == numbers | {"other": None, None: None}
    assert rows.limit(3).select(number_of("k", {}).alias("n")).distinct().collect()[0]["n"] is None
    assert spark.range(3).select(number_of("id", {"1": 5}).alias("n")).collect() == [(None,), (5.0,), (None,)]


def test_products_equal_those_of_the_matrix():
    import pandas as pd

    draw = np.random.default_rng(3)
    layout = Layout([Factor("a", F.lit("x"), list("xyz")), Number("u", F.lit(1)), Factor("b", F.lit("p"), list("pqrst")), Number("v", F.lit(1))])
    batch = pd.DataFrame({"t0": draw.integers(0, 3, 50), "t1": draw.normal(size=50), "t2": draw.integers(0, 5, 50), "t3": draw.normal(size=50)})
    w, beta, shape = draw.random(50), draw.normal(size=layout.width), Shape.of(layout)
    x, block, product = layout.matrix_builder()(batch), shape.block(batch), CrossProduct(shape)
    product.add(block, w)
    positions, values = product.cells()
    upper = np.zeros(layout.width * (layout.width + 1) // 2)
    upper[positions] = values
    assert len(set(positions)) == len(positions)
    assert np.allclose(symmetric(upper, layout.width), x.T @ (x * w[:, None]))
    assert np.allclose(block.predictor(beta), x @ beta) and np.allclose(block.sums(w), x.T @ w)
    assert np.array_equal(block.counts(), (x != 0).sum(axis=0))
    row, at, value = block.entries(w)
    dense = np.zeros_like(x)
    dense[row, at] = value
    assert np.allclose(dense, x * w[:, None])
    assert len(shape.block(batch[:0])) == 0 and not shape.block(batch[:0]).sums(w[:0]).any()


def test_explained_columns():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 6))
    x[:, 2], x[:, 5] = x[:, 0] - 2 * x[:, 1], 0.0
    gram = x.T @ x
    assert independent_columns(gram, range(6)) == [0, 1, 3, 4]
    assert independent_columns(gram, [0, 3, 4]) == [0, 3, 4]
    assert independent_columns(gram, []) == []


@pytest.fixture(scope="module")
def design(spark):
    """Twenty rows a level, whose share of ones and mean differ by level; one level has a third of all rows."""
    n = LEVELS * 20
    i = F.col("id")
    level = F.when(i >= n, 0).otherwise(i % LEVELS)
    place = (i / LEVELS).cast("int") % 20
    rows = spark.range(n + n // 2).select(
        level.cast("string").alias("level"), (place < 5 + level % 11).cast("int").alias("y"), (1 + i % 3).cast("double").alias("w"),
        (i % 7).alias("h"), (i % 91).alias("c"), (F.pmod(F.hash("id"), F.lit(1000)) / 100).alias("x"), F.when(i % 2 == 0, "a").otherwise("b").alias("g"),
    )
    return SurveyDesign(rows, "w", "h", "c")


def factor():
    return Factor("level", F.col("level"), [str(k) for k in range(LEVELS)])


def test_probit_of_many_levels(design):
    fit = fit_probit(design, F.col("y"), [factor()])
    means = design.data.groupBy("level").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).collect()
    wanted = {r["level"]: NormalDist().inv_cdf(r["m"]) for r in means}
    assert fit.converged and fit.n == LEVELS * 30 and len(fit.coefficients) == LEVELS
    for k in range(1, LEVELS):
        assert fit.coefficients[f"level{k}"] == pytest.approx(wanted[str(k)] - wanted["0"], abs=1e-6)
    assert np.all(np.diag(fit.covariance) > -1e-12) and np.isfinite(fit.covariance).all()


def test_linear_fit_of_many_levels_and_its_residuals(design):
    fit = fit_linear(design, 3 * F.col("x") + F.col("level").cast("int") % 5, [factor(), Number("x", F.col("x"))])
    assert fit.coefficients["x"] == pytest.approx(3.0) and fit.coefficients["level1234"] == pytest.approx(4.0, abs=1e-8)
    left = residuals(fit, 3 * F.col("x") + F.col("level").cast("int") % 5)
    assert design.data.agg(F.max(F.abs(left)).alias("most")).first()["most"] < 1e-7


def test_poststrata_take_their_means_off(design):
    """With the post-strata as the only term all scores add up to zero in each, so post-stratification changes no error."""
    totals = {r["g"]: r["t"] for r in design.data.groupBy("g").agg(F.sum("w").alias("t")).collect()}
    terms = [Factor("g", F.col("g"), ["a", "b"])]
    plain, adjusted = (fit_linear(d, F.col("y"), terms) for d in (design, poststratify(design, "g", totals)))
    assert np.allclose(plain.covariance, adjusted.covariance, rtol=1e-6, atol=1e-14) and plain.df == adjusted.df
