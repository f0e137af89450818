import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from panelweave.operators import glm, survival
from panelweave.operators.design import SurveyDesign
from panelweave.operators.glm import fit_linear, fit_probit, residuals
from panelweave.operators.model import Factor, Number, incomplete_beta, two_sided_p
from panelweave.operators.selection import heckman_two_step, with_mills
from panelweave.plans import bindings as b


def coefficients(fit):
    return {k: v for k, v in fit.coefficients.items()}


@pytest.fixture(scope="module")
def lines(spark, small_dir):
    return b.design(spark, small_dir)


@pytest.fixture(scope="module")
def orders(spark, small_dir):
    return b.order_design(spark, small_dir)


def test_linear_matches_least_squares(spark, lines):
    fit = fit_linear(lines, b.log_price(), [b.flag_factor(), b.status_factor(), b.quantity()], plain_scan=True)
    rows = lines.data.toPandas()
    x = np.column_stack(
        [np.ones(len(rows)), rows.l_returnflag == "N", rows.l_returnflag == "R", rows.l_linestatus == "O", rows.l_quantity]
    ).astype(float)
    w, y = rows.w.to_numpy(), np.log(rows.l_extendedprice.to_numpy())
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert list(coefficients(fit).values()) == pytest.approx(list(beta), rel=1e-9)
    assert list(coefficients(fit)) == ["(Intercept)", "flagN", "flagR", "statusO", "quantity"]

    scores = x * (w * (y - x @ beta))[:, None]
    bread = np.linalg.inv(x.T @ (x * w[:, None]))
    meat = np.zeros((5, 5))
    for _, stratum in rows.groupby("l_linenumber"):
        totals = np.array([scores[part.index].sum(axis=0) for _, part in stratum.groupby("psu")])
        centred = totals - totals.mean(axis=0)
        meat += len(totals) / (len(totals) - 1) * centred.T @ centred
    assert fit.covariance == pytest.approx(bread @ meat @ bread, rel=1e-8, abs=1e-18)
    assert fit.df == 70 - 7 + 1 - 5


def test_weighted_residuals_average_to_zero(lines):
    fit = fit_linear(lines, b.log_price(), [b.flag_factor(), b.quantity()], plain_scan=True)
    mean = lines.data.select(F.sum(F.col("w") * residuals(fit, b.log_price())) / F.sum("w")).first()[0]
    assert mean == pytest.approx(0.0, abs=1e-10)


def test_staged_and_plain_scan_agree(lines):
    terms = [b.flag_factor(), b.quantity()]
    one = fit_linear(lines, b.log_price(), terms, plain_scan=True)
    two = fit_linear(lines, b.log_price(), terms)
    assert list(one.coefficients.values()) == pytest.approx(list(two.coefficients.values()))


def test_many_clusters_are_handed_on_in_pieces(lines, monkeypatch):
    terms = [b.flag_factor(), b.quantity()]
    whole = fit_linear(lines, b.log_price(), terms)
    monkeypatch.setattr(glm, "HELD_CLUSTERS", 5)
    assert fit_linear(lines, b.log_price(), terms).covariance == pytest.approx(whole.covariance, rel=1e-9)


def test_unused_levels_and_aliased_terms(spark, lines):
    terms = [
        Factor("flag", F.col("l_returnflag"), ("?", "N", "A", "R", "!")),
        b.quantity(),
        Number("twice", F.col("l_quantity") * 2 + 1),
    ]
    fit = fit_linear(lines, b.log_price(), terms, plain_scan=True)
    assert list(fit.terms) == ["(Intercept)", "flagA", "flagR", "quantity", "twice"]
    assert fit.coefficients["twice"] is None
    row = fit.table(spark, "m").where("term = 'twice'").first()
    assert row["estimate"] is None and row["std_error"] is None


def test_rows_with_a_missing_term_are_left_out(spark):
    rows = [(1, "a", 1.0, 1.0, "x"), (1, "b", 1.0, 3.0, "x"), (1, "a", 1.0, None, "x"), (1, "b", 1.0, 99.0, None)]
    design = SurveyDesign(spark.createDataFrame(rows, "h int, c string, w double, y double, g string"), "w", "h", "c")
    fit = fit_linear(design, F.col("y"), [Factor("g", F.col("g"), ("x", "z"))])
    assert fit.n == 2 and fit.coefficients == {"(Intercept)": pytest.approx(2.0)}
    assert design.data.select(fit.predictor()).collect()[3][0] is None


def test_probit_matches_mllib(spark, orders):
    terms = [Factor("priority", F.col("o_orderpriority"), b.PRIORITIES), Number("lp", F.ln("o_totalprice"))]
    fit = fit_probit(orders, b.has_left().cast("int"), terms, plain_scan=True)
    assert fit.converged
    dummies = [(F.col("o_orderpriority") == p).cast("double").alias(f"p{i}") for i, p in enumerate(b.PRIORITIES[1:])]
    frame = orders.data.select("w", b.has_left().cast("double").alias("label"), *dummies, F.ln("o_totalprice").alias("lp"))
    vectors = VectorAssembler(inputCols=[f"p{i}" for i in range(4)] + ["lp"], outputCol="features").transform(frame)
    glr = GeneralizedLinearRegression(family="binomial", link="probit", weightCol="w", maxIter=50, tol=1e-12).fit(vectors)
    expected = [glr.intercept, *glr.coefficients]
    assert list(fit.coefficients.values()) == pytest.approx(expected, rel=1e-5, abs=1e-6)


def test_probit_score_is_zero_at_the_estimate(orders):
    fit = fit_probit(orders, b.has_left().cast("int"), [Number("lp", F.ln("o_totalprice"))], plain_scan=True)
    rows = orders.data.select("w", b.has_left().cast("int").alias("y"), F.ln("o_totalprice").alias("x")).toPandas()
    z = fit.coefficients["(Intercept)"] + fit.coefficients["lp"] * rows.x
    cdf = z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    score = rows.w * density * (rows.y - cdf) / (cdf * (1 - cdf))
    assert abs(score.sum()) < 1e-6 and abs((score * rows.x).sum()) < 1e-5


def test_separation_is_reported(spark):
    rows = [(1, str(i % 4), 1.0, int(i >= 20), float(i)) for i in range(40)]
    design = SurveyDesign(spark.createDataFrame(rows, "h int, c string, w double, y int, x double"), "w", "h", "c")
    fit = fit_probit(design, F.col("y"), [Number("x", F.col("x"))], plain_scan=True)
    assert not fit.converged


def test_cox_maximises_the_likelihood(spark):
    generator = np.random.default_rng(3)
    x = generator.integers(0, 2, 600)
    time = generator.integers(1, 5, 600)
    status = (generator.random(600) < 0.3 + 0.3 * x).astype(int)
    rows = [tuple(map(int, row)) for row in zip(x, time, status, strict=True)]
    frame = spark.createDataFrame(rows, "x int, time int, status int")
    fit = survival.fit_cox(frame, [Number("x", F.col("x"))])

    def likelihood(beta):
        total = 0.0
        for t in (1, 2, 3, 4):
            died = (time == t) & (status == 1)
            d, s0, d0 = died.sum(), np.exp(beta * x[time >= t]).sum(), np.exp(beta * x[died]).sum()
            total += beta * x[died].sum() - sum(math.log(s0 - k / d * d0) for k in range(d))
        return total

    grid = np.linspace(-2, 2, 4001)
    best = grid[np.argmax([likelihood(g) for g in grid])]
    estimate = fit.coefficients["x"]
    assert fit.converged and estimate == pytest.approx(best, abs=1e-3)
    step = 1e-4
    curvature = (likelihood(estimate + step) - 2 * likelihood(estimate) + likelihood(estimate - step)) / step**2
    assert fit.covariance[0, 0] == pytest.approx(-1 / curvature, rel=1e-3)


@pytest.mark.parametrize("a,d", [(1500.0, 1500), (5000.5, 1500), (1e7, 2000), (3000.3, 3000), (10.5, 3)])
def test_tied_sums(a, d):
    terms = a - np.arange(d)
    assert survival._tied_sums(a, d) == pytest.approx((np.log(terms).sum(), (1 / terms).sum(), (1 / terms**2).sum()), rel=1e-12)


def test_many_ties_use_the_closed_form(spark, monkeypatch):
    rows = [(i % 2, 1 + i % 3, int(i % 5 > 1)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "x int, time int, status int")
    direct = survival.fit_cox(frame, [Number("x", F.col("x"))])
    monkeypatch.setattr(survival, "DIRECT_TIES", 10)
    closed = survival.fit_cox(frame, [Number("x", F.col("x"))])
    assert closed.coefficients["x"] == pytest.approx(direct.coefficients["x"], rel=1e-9)


def test_cox_with_a_time_for_everyone(spark, monkeypatch):
    generator = np.random.default_rng(6)
    x = generator.normal(size=1500)
    time = generator.exponential(np.exp(-0.7 * x))
    status = (generator.random(1500) < 0.8).astype(int)
    rows = [(float(a), float(t), int(s)) for a, t, s in zip(x, time, status, strict=True)]
    frame = spark.createDataFrame(rows, "x double, time double, status int").repartition(6)
    fit = survival.fit_cox(frame, [Number("x", F.col("x"))])
    order = np.argsort(-time)
    x, status, beta = x[order], status[order], 0.0
    for _ in range(30):
        risk = np.exp(beta * x)
        s0, s1, s2 = np.cumsum(risk), np.cumsum(risk * x), np.cumsum(risk * x * x)
        score = ((x - s1 / s0) * status).sum()
        information = ((s2 / s0 - (s1 / s0) ** 2) * status).sum()
        beta += score / information
    assert fit.converged and fit.coefficients["x"] == pytest.approx(beta, rel=1e-8)
    assert fit.covariance[0, 0] == pytest.approx(1 / information, rel=1e-6)


def test_far_tails_keep_their_score():
    from panelweave.operators.glm import _probit_parts

    for eta in (-300.0, -39.0, -38.0, -20.0, -5.0, -0.5, 0.0, 0.5, 5.0, 20.0, 39.0):
        score, fisher, log_likelihood = (float(v[0]) for v in _probit_parts(np.array([eta]), np.array([1.0])))
        mirrored = _probit_parts(np.array([-eta]), np.array([0.0]))
        assert float(mirrored[0][0]) == -score and float(mirrored[2][0]) == log_likelihood
        if eta > -30:
            below = 0.5 * math.erfc(-eta / math.sqrt(2))
            assert score == pytest.approx(math.exp(-eta * eta / 2) / math.sqrt(2 * math.pi) / below, rel=1e-12)
            assert log_likelihood == pytest.approx(math.log(below) if eta < 5 else math.log1p(-0.5 * math.erfc(eta / math.sqrt(2))), rel=1e-9, abs=1e-300)
            assert fisher == pytest.approx(score * math.exp(-eta * eta / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(eta / math.sqrt(2)) or 1), rel=1e-9) or eta >= 20
        else:
            # x + 1/x - 2/x^3 and so on: the continued fraction of the normal tail.
            z = -eta
            assert score == pytest.approx(z + 1 / (z + 2 / (z + 3 / z)), rel=1e-9)
            assert log_likelihood == pytest.approx(-z * z / 2 - math.log(score * math.sqrt(2 * math.pi)), rel=1e-12)


def test_a_fit_keeps_its_accepted_step_when_every_halving_fails(spark, monkeypatch):
    from panelweave.operators import glm
    from panelweave.operators.design import SurveyDesign

    rows = [(i % 4, i % 2, float(i % 7), int(i * 7919 % 11 > 4), 1.0) for i in range(200)]
    design = SurveyDesign(spark.createDataFrame(rows, "c int, h int, x double, y int, w double"), "w", "h", "c")
    true, calls = glm._probit_sums, []

    def worse(frame, layout, beta):
        information, score, deviance, counts, n = true(frame, layout, beta)
        calls.append(beta.copy())
        return information, score, deviance + (1e6 if len(calls) > 2 else 0.0), counts, n

    monkeypatch.setattr(glm, "_probit_sums", worse)
    fit = glm.fit_probit(design, F.col("y"), [Number("x", F.col("x"))])
    assert not fit.converged
    assert list(fit.coefficients.values()) == pytest.approx(calls[1].tolist())


def test_km_reaches_zero(spark):
    frame = spark.createDataFrame([(2, 1), (3, 1)], "time int, status int")
    rows = survival.km_curve(frame).orderBy("time").collect()
    assert [r["surv"] for r in rows] == pytest.approx([0.5, 0.0])
    assert rows[1]["std_error"] is None and rows[1]["upper"] is None


def test_km_never_rises(spark, small_dir):
    from panelweave.plans.queries import km_curve_by

    curves = {}
    for r in km_curve_by(spark, small_dir).orderBy("time").collect():
        curves.setdefault((r["population"], r["stratum"]), []).append(r["surv"])
    assert all(list(c) == sorted(c, reverse=True) for c in curves.values())


def test_t_and_normal_tails():
    assert two_sided_p(2.0, 10.0) == pytest.approx(0.07338803, rel=1e-6)
    assert two_sided_p(1.959963984540054, None) == pytest.approx(0.05)
    assert two_sided_p(1.96, 1e7) == pytest.approx(two_sided_p(1.96, None), rel=1e-5)
    assert two_sided_p(1.0, 0.0) is None
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)


def test_two_step_uses_the_mills_ratio(spark, lines):
    selected = (F.col("l_discount") > 0).cast("int")
    tax = Number("tax", F.col("l_tax"))
    fit = heckman_two_step(lines, selected, [b.flag_factor(), tax], b.log_price(), [b.quantity()], plain_scan=True)
    by_hand = lines.with_data(with_mills(lines.data, fit.selection, "m"))
    again = fit_linear(by_hand, b.log_price(), [b.quantity(), Number("mills", F.col("m"))], F.col("l_discount") > 0)
    assert list(fit.outcome.coefficients.values()) == pytest.approx(list(again.coefficients.values()), rel=1e-6)
    z = fit.selection.coefficients["(Intercept)"]
    row = by_hand.data.where("l_returnflag = 'A' AND l_tax = 0").select("m").first()[0]
    assert row == pytest.approx(math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-z / math.sqrt(2))))
