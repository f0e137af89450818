"""Survey-weighted linear and probit regression with design-based standard errors.

Executors reduce rows to small cross-product matrices; the driver solves a system with one row per
term. Standard errors come from cluster totals of the scores, so no pass needs the rows in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.scalars import (
    CENTRE_BOTTOM,
    CENTRE_EDGE,
    CENTRE_TOP,
    INV_SQRT_2PI,
    MIDDLE_BOTTOM,
    MIDDLE_EDGE,
    MIDDLE_TOP,
    TAIL_BOTTOM,
    TAIL_TOP,
)
from panelweave.operators.design import SurveyDesign
from panelweave.operators.model import (
    Fit,
    Layout,
    Term,
    cell_rows,
    collected_vector,
    complete_rows,
    independent_columns,
    model_frame,
    solve_scaled,
    symmetric,
    vector_rows,
)
from panelweave.operators.products import CrossProduct, Shape
from panelweave.operators.skew import lookup_join
from panelweave.session import checkpointed, staged

MAX_ITERATIONS = 25
MAX_HALVINGS = 10
DEVIANCE_TOLERANCE = 1e-10
# Partial cluster sums a task keeps in memory before it hands them on.
HELD_CLUSTERS = 500_000
# The position of a cluster's weight among its scores.
WEIGHT = -1
# Numbers a task unpacks at a time when it multiplies cluster totals.
HELD_VALUES = 4_000_000


def fit_linear(
    design: SurveyDesign,
    response: Column,
    terms: Sequence[Term],
    domain: Column | None = None,
    plain_scan: bool = False,
) -> Fit:
    """Weighted least squares over the complete rows of the domain.

    `plain_scan` says that the design's rows come from a staged table, which is cheap to read again.
    """
    layout = Layout(terms)
    with staged(_frame(design, layout, response, domain), plain_scan) as rows:
        frame = complete_rows(rows).where(F.col("w") > 0)
        gram, cross, counts, n = _linear_sums(frame, layout)
        columns = independent_columns(gram, layout.kept(counts))
        beta = np.zeros(layout.width)
        beta[columns] = solve_scaled(gram[np.ix_(columns, columns)], cross[columns])
        return _finish(design, frame, layout, columns, counts, beta, gram, n, _linear_score, True)


def fit_probit(
    design: SurveyDesign,
    response: Column,
    terms: Sequence[Term],
    domain: Column | None = None,
    plain_scan: bool = False,
) -> Fit:
    """Weighted probit by Fisher scoring, one pass per step; a step that worsens the fit is halved."""
    whole = F.lit(True) if domain is None else domain
    alone = lambda frame, layout, betas: {0: _probit_sums(frame, layout, betas[0])}
    return _probits(design, response, terms, {"": whole}, plain_scan, alone)[""]


def fit_probits(
    design: SurveyDesign,
    response: Column,
    terms: Sequence[Term],
    domains: Mapping[str, Column],
    plain_scan: bool = False,
) -> dict[str, Fit]:
    """The weighted probit of every sub-population, all in the same passes.

    A pass builds the model matrix once and returns the sums of all models that are still moving, each at its own
    coefficients; steps are halved model by model, and a model that has converged leaves. One more pass gathers the
    scores of all models by cluster, and one cross-product holds all their covariances.
    """
    return _probits(design, response, terms, domains, plain_scan, _all_probit_sums) if domains else {}


def _probits(design, response, terms, domains, plain_scan, sums) -> dict[str, Fit]:
    layout = Layout(terms)
    inside = [F.coalesce(d, F.lit(False)) for d in domains.values()]
    flags = [c.alias(f"in{k}") for k, c in enumerate(inside)]
    with staged(_frame(design, layout, response.cast("double"), reduce(or_, inside), flags), plain_scan) as rows:
        frame = complete_rows(rows).where(F.col("w") > 0)
        models = [_Probit(layout) for _ in domains]
        while moving := [k for k, m in enumerate(models) if m.moving]:
            tried = sums(frame, layout, {k: models[k].tried for k in moving})
            for k in moving:
                models[k].take(tried[k])
        scored = [(f"in{k}", m.columns, m.beta) for k, m in enumerate(models)]
        covariances = _score_covariances(design, frame, layout, scored, _probit_score)
        fits = [_fitted(m, layout, *found) for m, found in zip(models, covariances, strict=True)]
    return dict(zip(domains, fits, strict=True))


class _Probit:
    """Step control of one model: what it tries next, and what the sums of that trial lead to."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.beta, self.step = np.zeros(layout.width), np.zeros(layout.width)
        self.deviance: float | None = None
        self.steps = self.halvings = 0
        self.moving, self.converged = True, False

    @property
    def tried(self) -> np.ndarray:
        return self.beta + self.step

    def take(self, sums: tuple[np.ndarray, np.ndarray, float, np.ndarray, int]) -> None:
        information, score, deviance, counts, n = sums
        if self.deviance is None:
            self.counts, self.n = counts, n
            self.columns = independent_columns(information, self.layout.kept(counts))
        elif not (math.isfinite(deviance) and deviance <= self.deviance * (1 + 1e-9) + 1e-9):
            self.step = self.step / 2.0
            self.halvings += 1
            # Where no step of this direction helps, the accepted coefficients stay.
            self.moving = self.halvings < MAX_HALVINGS
            return
        else:
            self.beta = self.tried
            if abs(deviance - self.deviance) / (abs(deviance) + 0.1) < DEVIANCE_TOLERANCE:
                self.moving, self.converged = False, True
        self.information, self.score, self.deviance, self.halvings = information, score, deviance, 0
        self.steps += 1
        if self.moving:
            self._next()

    def _next(self) -> None:
        columns = self.columns
        try:
            self.step = np.zeros(self.layout.width)
            self.step[columns] = solve_scaled(self.information[np.ix_(columns, columns)], self.score[columns])
            self.moving = self.steps <= MAX_ITERATIONS
        except np.linalg.LinAlgError:
            self.moving = False


def _fitted(model: _Probit, layout: Layout, meat: np.ndarray, clusters: int, strata: int) -> Fit:
    return _assembled(layout, model.columns, model.counts, model.beta, model.information, model.n, model.converged, meat, clusters, strata)


def residuals(fit: Fit, response: Column) -> Column:
    """Response minus the linear predictor."""
    return response - fit.predictor()


# --- rows to sums --------------------------------------------------------------------------------


def _frame(design: SurveyDesign, layout: Layout, response: Column, domain: Column | None, flags: Sequence[Column] = ()) -> DataFrame:
    columns = [F.col(design.strata).alias("h"), F.col(design.psu).alias("c")]
    if design.poststratum:
        columns.append(F.col(design.poststratum).alias("g"))
    weight = F.col(design.weight).cast("double")
    return model_frame(design.data, layout, [*columns, *flags, weight.alias("w"), response.cast("double").alias("y")], domain)


def _linear_sums(frame: DataFrame, layout: Layout):
    shape, cells = Shape.of(layout), _cells(layout.width)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, rest = CrossProduct(shape), np.zeros(2 * shape.width + 1)
        for batch in batches:
            block, w, y = shape.block(batch), batch["w"].to_numpy(float), batch["y"].to_numpy(float)
            products.add(block, w)
            rest += np.concatenate([block.sums(w * y), block.counts(), [len(block)]])
        yield cell_rows(*products.cells())
        yield cell_rows(cells + np.arange(len(rest)), rest)

    names = [*layout.column_names(), "w", "y"]
    return _split(collected_vector(frame.select(*names), partials, cells + 2 * layout.width + 1), layout.width)


def _cells(width: int) -> int:
    return width * (width + 1) // 2


def _split(total: np.ndarray, width: int):
    cells = _cells(width)
    gram = symmetric(total[:cells], width)
    return gram, total[cells : cells + width], total[cells + width : cells + 2 * width], int(total[cells + 2 * width])


def _probit_sums(frame: DataFrame, layout: Layout, beta: np.ndarray) -> tuple:
    return _all_probit_sums(frame, layout, {0: beta})[0]


def _all_probit_sums(frame: DataFrame, layout: Layout, betas: Mapping[int, np.ndarray]) -> dict[int, tuple]:
    """(information, score, deviance, counts, rows) of each model at its coefficients; model k holds for rows with `in<k>`."""
    shape, width, cells = Shape.of(layout), layout.width, _cells(layout.width)
    size = cells + 2 * width + 2

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products = {k: CrossProduct(shape) for k in betas}
        rest = {k: np.zeros(2 * width + 2) for k in betas}
        for batch in batches:
            whole, w, y = shape.block(batch), batch["w"].to_numpy(float), batch["y"].to_numpy(float)
            for k, beta in betas.items():
                mine = batch[f"in{k}"].to_numpy(bool)
                block, weight = whole.of_rows(mine), w[mine]
                score, fisher, log_likelihood = _probit_parts(block.predictor(beta), y[mine])
                products[k].add(block, weight * fisher)
                deviance = -2.0 * float(weight @ log_likelihood)
                rest[k] += np.concatenate([block.sums(weight * score), block.counts(), [len(block), deviance]])
        for number, k in enumerate(betas):
            positions, values = products[k].cells()
            yield cell_rows(number * size + positions, values)
            yield cell_rows(number * size + cells + np.arange(2 * width + 2), rest[k])

    names = [*layout.column_names(), "w", "y", *[f"in{k}" for k in betas]]
    totals = collected_vector(frame.select(*names), partials, size * len(betas)).reshape(len(betas), size)
    out = {}
    for k, total in zip(betas, totals, strict=True):
        information, score, counts, n = _split(total, width)
        out[k] = information, score, float(total[-1]), counts, n
    return out


def _probit_parts(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: score and Fisher weight with respect to the linear predictor, and the log-likelihood.

    Far from the centre density and tail share the factor exp(-eta^2 / 2). It cancels in their ratio and is a
    plain term of the logarithm, so both stay exact however small the probability is.
    """
    size = np.abs(eta)
    central = size <= CENTRE_EDGE
    square = eta * eta
    far = np.where(central, 1.0, size)
    near_zero = np.where(central, eta, 0.0)
    half = near_zero * np.polyval(CENTRE_TOP, near_zero**2) / np.polyval(CENTRE_BOTTOM, near_zero**2)
    middle = np.minimum(far, MIDDLE_EDGE)
    inverse = 1.0 / np.maximum(far, MIDDLE_EDGE) ** 2
    beyond = (INV_SQRT_2PI - inverse * np.polyval(TAIL_TOP, inverse) / np.polyval(TAIL_BOTTOM, inverse)) / far
    scaled = np.where(far <= MIDDLE_EDGE, np.polyval(MIDDLE_TOP, middle) / np.polyval(MIDDLE_BOTTOM, middle), beyond)
    falling = np.exp(-0.5 * square)
    small = np.where(central, 0.5 - np.abs(half), scaled * falling)
    density = INV_SQRT_2PI * falling
    # Of the two probabilities the smaller one is in scaled form, the larger one its complement.
    with np.errstate(divide="ignore"):
        log_small = np.where(central, np.log(0.5 - np.abs(half)), np.log(scaled) - 0.5 * square)
    ratio_small = np.where(central, density / (0.5 - np.abs(half)), INV_SQRT_2PI / scaled)
    ratio_large, log_large = density / (1.0 - small), np.log1p(-small)
    up = eta >= 0
    above, below = np.where(up, ratio_large, ratio_small), np.where(up, ratio_small, ratio_large)
    log_above, log_below = np.where(up, log_large, log_small), np.where(up, log_small, log_large)
    return y * above - (1.0 - y) * below, above * below, y * log_above + (1.0 - y) * log_below


def _linear_score(eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y - eta


def _probit_score(eta: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _probit_parts(eta, y)[0]


# --- design-based covariance ---------------------------------------------------------------------


def _finish(design, frame, layout, columns, counts, beta, information, n, score, converged) -> Fit:
    (found,) = _score_covariances(design, frame, layout, [(None, columns, beta)], score)
    return _assembled(layout, columns, counts, beta, information, n, converged, *found)


def _assembled(layout, columns, counts, beta, information, n, converged, meat, clusters, strata) -> Fit:
    names = tuple(layout.names[k] for k in layout.kept(counts))
    coefficients = dict.fromkeys(names)
    coefficients.update({layout.names[k]: float(beta[k]) for k in columns})
    bread = solve_scaled(information[np.ix_(columns, columns)])
    df = clusters - strata + 1 - len(columns)
    return Fit(layout, names, coefficients, bread @ meat @ bread, float(df), converged, n)


def _score_covariances(
    design, frame, layout, models: Sequence[tuple[str | None, Sequence[int], np.ndarray]], score
) -> list[tuple[np.ndarray, int, int]]:
    """For each model (flag, columns, beta) the between-cluster covariance of its score totals, and its clusters and strata.

    A cluster's scores are rows (pos, value), only of the columns that its rows have, each model at its own positions
    and then one position a model for its rows. With post-strata the score is net of the weight times the mean score of
    the post-stratum; the weights follow at positions of their own, and the driver takes the means off the cross-product.
    """
    keys = ["h", "c"] + (["g"] if design.poststratum else [])
    names = dict(zip(keys, [design.strata, design.psu, design.poststratum], strict=False))
    # Every cluster of the design takes part, also one without a row in the fit: its weight stands at WEIGHT.
    places = [F.col(name).alias(k) for k, name in names.items()]
    whole = design.data.select(*places, F.lit(WEIGHT).alias("pos"), F.col(design.weight).cast("double").alias("value"))
    rows = _score_rows(frame, layout, models, score, keys).unionByName(whole)
    sums = checkpointed(rows.groupBy(*keys, "pos").agg(F.sum("value").alias("value")))
    places = sums.where(F.col("pos") == WEIGHT).select(*keys, F.col("value").alias("w"))
    cells = sums.where(F.col("pos") != WEIGHT)
    factors = SurveyDesign(places, "w", "h", "c", lonely_psu=design.lonely_psu).stratum_factors(places)

    starts = np.cumsum([0, *[len(columns) for _, columns, _ in models]])
    width = int(starts[-1])
    totals, means = cells, None
    if design.poststratum:
        cells = cells.where(F.col("g").isNotNull())
        weights = places.where(F.col("g").isNotNull())
        groups = {row["g"]: (k, row["w"]) for k, row in enumerate(weights.groupBy("g").agg(F.sum("w").alias("w")).collect())}
        first = width + len(models)
        schema = T.StructType([places.schema["g"], T.StructField("pos", T.IntegerType())])
        numbers = frame.sparkSession.createDataFrame([(g, first + k) for g, (k, _) in groups.items()], schema)
        totals = cells.drop("g").unionByName(lookup_join(weights, numbers, ["g"]).select("h", "c", "pos", F.col("w").alias("value")))
        totals = totals.groupBy("h", "c", "pos").agg(F.sum("value").alias("value"))
        means = np.zeros((len(groups), width))
        for row in cells.where(F.col("pos") < width).groupBy("g", "pos").agg(F.sum("value").alias("value")).toLocalIterator():
            k, weight = groups[row["g"]]
            means[k, row["pos"]] = row["value"] / weight if weight else 0.0

    # The covariance is a weighted cross-product of cluster rows less one of stratum rows. A row's cells are at most
    # as many as the models have terms.
    vector = F.collect_list(F.struct("pos", "value")).alias("cells")
    by_stratum = totals.groupBy("h", "pos").agg(F.sum("value").alias("value")).groupBy("h").agg(vector)
    by_stratum = by_stratum.join(factors, "h").select((-F.col("factor") / F.col("n_psu")).alias("w"), "cells", F.lit(True).alias("stratum"))
    by_cluster = totals.groupBy("h", "c").agg(vector).join(factors, "h")
    vectors = by_cluster.select(F.col("factor").alias("w"), "cells", F.lit(False).alias("stratum")).unionByName(by_stratum)
    shared = width + len(models) + np.arange(0 if means is None else len(means))
    spans = [np.r_[start:end, shared] for start, end in zip(starts, starts[1:], strict=False)]
    out = []
    grams, clusters, strata = _grams(vectors, spans, width)
    for k, gram in enumerate(grams):
        size = starts[k + 1] - starts[k]
        if means is not None:
            net = np.vstack([np.eye(size), -means[:, starts[k] : starts[k + 1]]])
            gram = net.T @ gram @ net
        out.append((gram, int(clusters[k]), int(strata[k])))
    return out


def _score_rows(frame, layout, models, score, keys) -> DataFrame:
    """Score sums (keys, pos, value) per cluster, folded within each task; tasks meet in the following grouped sum.

    A task holds at most HELD_CLUSTERS partial rows before it hands them on.
    """
    shape, limit = Shape.of(layout), HELD_CLUSTERS
    flags = [flag for flag, _, _ in models if flag]
    schema = T.StructType([*[frame.schema[k] for k in keys], T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType())])
    width = sum(len(columns) for _, columns, _ in models)

    def folded(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby([*keys, "pos"], sort=False, dropna=False)["value"].sum().reset_index()

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            block, w, y = shape.block(batch), batch["w"].to_numpy(float), batch["y"].to_numpy(float)
            start, rows, positions, values = 0, [], [], []
            for k, (flag, columns, beta) in enumerate(models):
                inside = batch[flag].to_numpy(bool) if flag else np.ones(len(block), bool)
                place = np.full(shape.width, -1)
                place[list(columns)] = start + np.arange(len(columns))
                start += len(columns)
                mine = np.flatnonzero(inside)
                part = block.of_rows(mine)
                row, at, value = part.entries(score(part.predictor(beta), y[mine]) * w[mine])
                kept = place[at] >= 0
                rows += [mine[row[kept]], mine]
                positions += [place[at[kept]], np.full(len(mine), width + k)]
                values += [value[kept], np.ones(len(mine))]
            row = np.concatenate(rows)
            out = {key: batch[key].to_numpy()[row] for key in keys}
            out |= {"pos": np.concatenate(positions).astype("int32"), "value": np.concatenate(values)}
            held.append(folded([pd.DataFrame(out)]))
            if sum(map(len, held)) > limit:
                held = [folded(held)]
                if len(held[0]) > limit // 2:
                    yield held.pop()
        if held:
            yield folded(held)

    return frame.select(*keys, *layout.column_names(), "w", "y", *flags).mapInPandas(partials, schema)


def _grams(frame: DataFrame, spans: Sequence[np.ndarray], first: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each span of positions the weighted cross-product of the rows' vectors there; a vector is its (pos, value) cells.

    Also how many cluster rows and stratum rows hold each of the positions from `first` on, one a span: a
    model's clusters and strata.
    """
    uppers = [np.triu_indices(len(span)) for span in spans]
    ends = np.cumsum([0, *[len(upper[0]) for upper in uppers]])
    size = max([first + len(spans), *[int(span.max()) + 1 for span in spans if len(span)]])
    step = max(1, HELD_VALUES // max(size, 1))

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros((len(span), len(span))) for span in spans]
        held = np.zeros((2, len(spans)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                dense = np.zeros((len(part), size))
                for row, cells in zip(dense, part["cells"], strict=True):
                    row[[cell["pos"] for cell in cells]] = [cell["value"] for cell in cells]
                by_stratum = part["stratum"].to_numpy(bool)
                present = dense[:, first : first + len(spans)] > 0
                held += [present[~by_stratum].sum(axis=0), present[by_stratum].sum(axis=0)]
                weighted = dense * part["w"].to_numpy(float)[:, None]
                for total, span in zip(totals, spans, strict=True):
                    total += dense[:, span].T @ weighted[:, span]
        yield vector_rows(np.concatenate([*[total[upper] for total, upper in zip(totals, uppers, strict=True)], held.ravel()]))

    found = collected_vector(frame, partials, int(ends[-1]) + 2 * len(spans))
    clusters, strata = found[ends[-1] :].reshape(2, -1)
    return [symmetric(found[a:b], len(span)) for a, b, span in zip(ends, ends[1:], spans, strict=False)], clusters, strata
