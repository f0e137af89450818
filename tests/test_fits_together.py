"""Probits of several sub-populations in the same passes against one fit each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import glm
from panelweave.operators.design import SurveyDesign, poststratify
from panelweave.operators.glm import fit_probit, fit_probits
from panelweave.operators.model import Factor, Number


@pytest.fixture(scope="module")
def design(spark):
    draw = np.random.default_rng(8)
    n = 4000
    x, kind, size = draw.normal(size=n), draw.integers(0, 3, n), draw.integers(0, 100, n)
    y = (0.4 * x + 0.5 * (kind == 1) - 0.2 + draw.normal(size=n) > 0).astype(int)
    rows = [(i % 5, i % 40, "ab"[i % 2], float(1 + i % 3), float(x[i]), f"k{kind[i]}", int(size[i]), int(y[i])) for i in range(n)]
    return SurveyDesign(spark.createDataFrame(rows, "h int, c int, g string, w double, x double, kind string, size int, y int"), "w", "h", "c", lonely_psu="remove")


def terms():
    return [Number("x", F.col("x")), Factor("kind", F.col("kind"), ["k0", "k1", "k2"])]


def domains():
    return {
        "all": F.lit(True), "small": F.col("size") < 30, "one_kind": F.col("kind") == "k1",
        "separated": ((F.col("x") > 0) == (F.col("y") == 1)) & (F.col("size") < 20), "nobody": F.col("size") > 1000, "unknown": F.lit(None).cast("boolean"),
    }


def same(a, b):
    assert a.terms == b.terms and a.n == b.n and a.df == b.df and a.converged == b.converged
    assert list(a.coefficients.values()) == pytest.approx(list(b.coefficients.values()), rel=1e-8)
    assert np.allclose(a.covariance, b.covariance, rtol=1e-6, atol=1e-12)


def test_each_as_if_alone(design):
    wanted = {k: v for k, v in domains().items() if k in ("all", "small", "one_kind")}
    together = fit_probits(design, F.col("y"), terms(), wanted)
    assert list(together) == list(wanted)
    for name, inside in wanted.items():
        same(together[name], fit_probit(design, F.col("y"), terms(), inside))
    # The only level left is the base.
    assert together["all"].converged and together["one_kind"].coefficients.keys() == {"(Intercept)", "x"}


def test_hard_models_do_not_hold_up_others(design):
    together = fit_probits(design, F.col("y"), terms(), domains())
    same(together["all"], fit_probit(design, F.col("y"), terms()))
    assert together["nobody"].n == together["unknown"].n == 0
    assert together["nobody"].covariance.shape == (0, 0) and set(together["nobody"].coefficients.values()) <= {None}
    assert not together["separated"].converged or max(abs(v) for v in together["separated"].coefficients.values()) > 3


def test_poststratified(design):
    adjusted = poststratify(design, "g", {"a": 3000.0, "b": 5000.0})
    together = fit_probits(adjusted, F.col("y"), terms(), {"all": F.lit(True), "small": F.col("size") < 30})
    same(together["small"], fit_probit(adjusted, F.col("y"), terms(), F.col("size") < 30))


def test_passes_are_shared_and_converged_models_leave(design, monkeypatch):
    true, moving = glm._all_probit_sums, []
    monkeypatch.setattr(glm, "_all_probit_sums", lambda frame, layout, betas: moving.append(list(betas)) or true(frame, layout, betas))
    fits = fit_probits(design, F.col("y"), terms(), {"all": F.lit(True), "small": F.col("size") < 30, "nobody": F.lit(False)})
    assert fits["all"].converged and moving[0] == [0, 1, 2] and len(moving) < 9
    assert all(set(b) <= set(a) for a, b in zip(moving, moving[1:], strict=False)) and 2 not in moving[3]


def test_no_sub_population(design):
    assert fit_probits(design, F.col("y"), terms(), {}) == {}
